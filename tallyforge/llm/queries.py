"""The operators as queries over the given tables, whole, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm import alignment, covertree, decontaminate, html, merkle, mixing, quality, secrets, shards, simhash, tokens, transport, warc
from tallyforge.llm.common import read
from tallyforge.llm.registry import query

TOKENIZER = "word_bpe_49k.json"
BYTE_LEVEL, PIECES = "byte_bpe_50k.json", "piece_bpe_32k.model"


def tokenizer_definition(path: str | None = None) -> str:
    """The JSON text of a tokenizer file, by default the public one the queries use."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(TOKENIZER)
    with open(path, encoding="utf-8") as f:
        return f.read()


def alignment_files(byte_level: str | None = None, pieces: str | None = None) -> tuple[str, bytes]:
    """The definition of a byte-level tokenizer and the model of a piece tokenizer, by default the public ones the queries use."""
    if byte_level is None or pieces is None:
        import public_tokenizers

        byte_level, pieces = byte_level or public_tokenizers.path(BYTE_LEVEL), pieces or public_tokenizers.path(PIECES)
    with open(byte_level, encoding="utf-8") as a, open(pieces, "rb") as b:
        return a.read(), b.read()


@query("op10_simhash_components")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.near_duplicates(read(spark, folder, "documents"))
    return found.select("doc_id", simhash.fingerprint_hex(F.col("fp")).alias("fingerprint"), "component_id")


@query("op1_warc_bundles")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    pages = read(spark, folder, "pages")
    kind = pages.schema["page_id"].dataType
    found = warc.read_records(spark, warc.write_bundles(pages))
    return found.withColumns({c: F.col(c).cast(kind) for c in ("page_id", "refers_to")})


@query("op7_pfor_tokens")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents")
    found = tokens.read_documents(spark, tokens.write_tokens(docs, tokenizer_definition()))
    return found.select("doc_id", "start", "n_tokens", "ids_crc32")


@query("op2_virtual_slots")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    return shards.assign(read(spark, folder, "documents"))


def _demand_time_sql(share: str) -> str:
    """The time at which each kind of schedule has brought ``share`` of its demand."""
    kinds = []
    for k, points in enumerate(mixing.SCHEDULES):
        pieces = mixing.schedule_pieces(points)
        cases = " ".join(
            f"WHEN {share} <= {after!r}::DOUBLE THEN {start!r}::DOUBLE + CASE WHEN {share} - {before!r}::DOUBLE <= 0 THEN 0 ELSE 2 * ({share} - {before!r}::DOUBLE) / ("
            f"{strength!r}::DOUBLE + sqrt(greatest({strength * strength!r}::DOUBLE + ({share} - {before!r}::DOUBLE) * {2 * slope!r}::DOUBLE, 0))) END"
            for start, strength, slope, before, after in pieces)
        kinds.append(f"WHEN {k} THEN CASE {cases} ELSE 1 END")
    return f"CASE n % {len(mixing.SCHEDULES)} {' '.join(kinds)} END"


OP6_SQL = f"""
WITH docs AS (
    SELECT doc_id, text, source, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')) AS size,
           md5(coalesce(cast(doc_id AS varchar), text, '')) AS key FROM documents),
sources AS (SELECT source, sum(size)::bigint AS source_size FROM docs GROUP BY source),
numbered AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS n, source_size * 3 AS most FROM sources),
weighted AS (SELECT *, [5, 2, 1][(n % 3 + 1)::int] AS weight FROM numbered),
levels AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(most) OVER w, 0))::double
                     / (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0)) AS level
           FROM weighted WINDOW w AS (ORDER BY most / weight, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
share AS (SELECT arg_min(level, (most / weight, n)) AS share FROM levels WHERE level <= most / weight),
targets AS (SELECT source, n, source_size, least(share * weight, most::double) AS target FROM levels, share),
placed AS (SELECT d.doc_id, d.size, t.source_size, t.target, t.n, round(t.target)::bigint AS due,
                  coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id, d.size
                                             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::bigint AS first
           FROM docs d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source),
counted AS (SELECT *, len([p FOR p IN [0, 1, 2, 3] IF greatest(0, least(size, due - first - source_size * p)) > 0]) AS passes FROM placed),
shares AS (SELECT *, first / due AS early, (first + source_size * (passes - 1)) / due AS late FROM counted)
SELECT doc_id, size, source_size, target,
       list_sum([greatest(0, least(size, due - first - source_size * p)) FOR p IN [0, 1, 2, 3]])::bigint AS taken, passes::int AS passes,
       CASE WHEN passes > 0 THEN round({_demand_time_sql("early")}, 9) END AS first_position,
       CASE WHEN passes > 0 THEN round({_demand_time_sql("late")}, 9) END AS last_position FROM shares"""


@query("op6_curriculum_mix", OP6_SQL)
def op6(spark: SparkSession, folder: str) -> DataFrame:
    mixed = mixing.with_passes(read(spark, folder, "documents"), carry=["doc_id"])
    ordered = mixed.orderBy(F.get("passes", F.lit(0))["position"].asc_nulls_last(), "row.doc_id")
    position = [F.round(F.get("passes", at)["position"], 9) for at in (F.lit(0), F.size("passes") - 1)]
    return ordered.select("row.doc_id", "size", "source_size", "target", "taken", F.size("passes").alias("passes"),
                          position[0].alias("first_position"), position[1].alias("last_position"))


@query("op8_line_crf_quality")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents").select("doc_id", "text")
    scored = quality.with_scores(docs, quality.train(docs, read(spark, folder, "labels")))
    return scored.select("row.doc_id", quality.held_out(F.col("row.doc_id")).alias("held_out"), "score",
                         quality.predicted(F.col("score")).alias("predicted"))


@query("op9_transport_streams")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    return transport.read_media(spark.read.parquet(transport.write_media(read(spark, folder, "documents"))))


OP4_SQL = r"""
WITH texts AS (SELECT doc_id, translate(coalesce(text, ''), chr(1) || chr(2), chr(3) || chr(3)) AS text FROM documents),
marked AS (
    SELECT doc_id, kind, rank, least, pattern, grp,
           string_split_regex(regexp_replace(text, pattern, chr(1) || '\0' || chr(2), 'g'), '[\x01\x02]') AS pieces
    FROM texts CROSS JOIN (VALUES
        ('assign', 0, 8, 2, '(?i)(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)'),
        ('access', 1, 16, 0, 'AKIA[A-Z0-9]+'), ('hex', 2, 32, 0, '[0-9a-f]+')) AS r(kind, rank, least, grp, pattern)),
pieces AS (SELECT doc_id, kind, rank, least, pattern, grp, unnest(pieces) AS piece, generate_subscripts(pieces, 1) AS i FROM marked),
placed AS (SELECT *, (sum(length(piece)) OVER (PARTITION BY doc_id, kind ORDER BY i) - length(piece))::bigint AS start FROM pieces),
found AS (SELECT doc_id, kind, rank, start, start + length(piece) AS stop FROM placed
          WHERE i % 2 = 0 AND length(CASE WHEN grp = 2 THEN regexp_extract(piece, pattern, 2) ELSE piece END) >= least),
listed AS (SELECT t.doc_id, count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access,
                  count(*) FILTER (WHERE kind = 'hex') AS n_hex,
                  coalesce(string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank), '') AS spans
           FROM texts t LEFT JOIN found USING (doc_id) GROUP BY t.doc_id)
SELECT *, sha256(spans) AS base_sha256 FROM listed"""


@query("op4_trigram_secrets", OP4_SQL)
def op4(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.scan(read(spark, folder, "documents"))


@query("op5_page_differencing")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    return html.extract(read(spark, folder, "pages"))


OP3_SQL = r"""
WITH docs AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS words FROM documents),
items AS (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS words FROM benchmark),
item_shingles AS (SELECT item_id, len(words) AS n, unnest([array_to_string(words[i:i + 4], ' ') FOR i IN range(1, len(words) - 3)]) AS s FROM items),
weights AS (SELECT item_id, n, s, count(*) AS c FROM item_shingles GROUP BY ALL),
doc_shingles AS (SELECT doc_id, len(words) AS size, unnest([{'pos': i - 1, 's': array_to_string(words[i:i + 4], ' ')}
                        FOR i IN range(1, len(words) - 3)], recursive := true) FROM docs WHERE len(words) >= 5),
places AS (SELECT doc_id, size, item_id, n, s, c, pos FROM doc_shingles JOIN weights USING (s)),
pairs AS (SELECT doc_id, item_id FROM (SELECT DISTINCT doc_id, item_id, n, s, c FROM places) GROUP BY doc_id, item_id HAVING sum(c) >= 0.8 * (any_value(n) - 4)),
able AS (SELECT * FROM places JOIN pairs USING (doc_id, item_id)),
starts AS (SELECT DISTINCT doc_id, item_id, n, size, unnest(range(greatest(0, pos - n + 5), pos + 1)) AS start FROM able),
counted AS (SELECT t.doc_id, t.item_id, t.n, t.start, a.s, least(count(*), any_value(a.c)) AS shared
            FROM starts t JOIN able a ON t.doc_id = a.doc_id AND t.item_id = a.item_id AND a.pos BETWEEN t.start AND t.start + t.n - 5
            WHERE t.start + t.n <= t.size GROUP BY t.doc_id, t.item_id, t.n, t.start, a.s),
scored AS (SELECT doc_id, item_id, n, start, sum(shared) / (n - 4)::double AS similarity FROM counted GROUP BY doc_id, item_id, n, start)
SELECT doc_id, item_id, n::int AS n_words, arg_min(start, (-similarity, start))::int AS start, max(similarity) AS similarity
FROM scored WHERE similarity >= 0.8 - 1e-9 GROUP BY doc_id, item_id, n"""


@query("op3_simhash_windows", OP3_SQL)
def op3(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.contaminated(read(spark, folder, "documents"), read(spark, folder, "benchmark"))


@query("op11_arrow_alignment")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    return alignment.with_pair_counts(read(spark, folder, "documents"), *alignment_files())


OP12_SQL = r"""
WITH RECURSIVE fields AS (
    SELECT doc_id, lang, text, concat_ws('', coalesce(strlen(doc_id::varchar) || ':' || doc_id, '-'), coalesce(strlen(source) || ':' || source, '-'),
                                     coalesce(strlen(lang) || ':' || lang, '-'), coalesce(strlen(n_chars::varchar) || ':' || n_chars, '-')) AS head FROM documents),
checked AS (SELECT *, xor(list_reduce(range(8 * length(doc_id::varchar)), lambda c, i: CASE
        WHEN xor(c, CASE WHEN i % 8 = 0 THEN ascii(substr(doc_id::varchar, (i // 8)::bigint + 1, 1)) ELSE 0 END::bigint) % 2 = 1
        THEN xor(xor(c, CASE WHEN i % 8 = 0 THEN ascii(substr(doc_id::varchar, (i // 8)::bigint + 1, 1)) ELSE 0 END::bigint) // 2, 3988292384)
        ELSE xor(c, CASE WHEN i % 8 = 0 THEN ascii(substr(doc_id::varchar, (i // 8)::bigint + 1, 1)) ELSE 0 END::bigint) // 2 END, 4294967295), 4294967295) AS crc FROM fields),
hashed AS (
    SELECT doc_id, lang, crc, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
           sha256(head || coalesce(strlen(text) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-')) AS low FROM checked),
leaves AS (SELECT doc_id, lang, leaf, CASE WHEN crc % 3 = 0 THEN low ELSE leaf END AS own,
                  row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM hashed),
nodes AS (
    SELECT 0 AS level, lang, pos, n, leaf AS digest FROM leaves
    UNION ALL
    SELECT level + 1, lang, pos // 8, (n + 7) // 8, sha256(string_agg(digest, '' ORDER BY pos)) FROM nodes WHERE n > 1 GROUP BY level, lang, pos // 8, n),
subroots AS (SELECT lang, digest AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM nodes WHERE n = 1),
tops AS (
    SELECT 0 AS level, pos, n, subroot AS digest FROM subroots
    UNION ALL
    SELECT level + 1, pos // 8, (n + 7) // 8, sha256(string_agg(digest, '' ORDER BY pos)) FROM tops WHERE n > 1 GROUP BY level, pos // 8, n),
steps AS (
    SELECT level, lang, pos, coalesce(string_agg(digest, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
           coalesce(string_agg(digest, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM nodes WHERE n > 1
    WINDOW w AS (PARTITION BY level, lang, pos // 8 ORDER BY pos)),
top_steps AS (
    SELECT level, pos, coalesce(string_agg(digest, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
           coalesce(string_agg(digest, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM tops WHERE n > 1
    WINDOW w AS (PARTITION BY level, pos // 8 ORDER BY pos)),
folded AS (
    SELECT 0 AS level, lang, pos, pos AS at, own AS acc, '' AS proof FROM leaves
    UNION ALL
    SELECT f.level + 1, f.lang, f.pos, f.at // 8, sha256(l || acc || r), proof || l || r
    FROM folded f JOIN steps s ON s.level = f.level AND s.lang IS NOT DISTINCT FROM f.lang AND s.pos = f.at),
at_subroot AS (SELECT * FROM folded QUALIFY level = max(level) OVER (PARTITION BY lang)),
folded_top AS (
    SELECT 0 AS level, a.lang, a.pos, s.pos AS at, acc, proof, subroot FROM at_subroot a JOIN subroots s ON a.lang IS NOT DISTINCT FROM s.lang
    UNION ALL
    SELECT f.level + 1, f.lang, f.pos, f.at // 8, sha256(l || acc || r), proof || l || r, subroot FROM folded_top f JOIN top_steps s ON s.level = f.level AND s.pos = f.at)
SELECT v.doc_id, leaf, subroot, (SELECT digest FROM tops WHERE n = 1) AS root, sha256(proof) AS proof_sha256, acc AS folded_root,
       acc = (SELECT digest FROM tops WHERE n = 1) AS verified
FROM folded_top f JOIN leaves v ON v.lang IS NOT DISTINCT FROM f.lang AND v.pos = f.pos WHERE f.level = (SELECT max(level) FROM tops)"""


@query("op12_slot_pivot", OP12_SQL)
def op12(spark: SparkSession, folder: str) -> DataFrame:
    return merkle.verify(read(spark, folder, "documents"))


OP13_SQL = """
WITH RECURSIVE able AS (SELECT vec_id, embedding::double[] AS v FROM embeddings
    WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM able a JOIN able b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE list_cosine_similarity(a.v, b.v) >= 0.95),
reached AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reached r JOIN links l ON r.b = l.a),
components AS (SELECT a AS vec_id, min(b) AS component_id FROM reached GROUP BY a)
SELECT vec_id, (SELECT count(*) FROM links l WHERE l.a = e.vec_id) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings e JOIN components USING (vec_id)"""


@query("op13_cover_tree", OP13_SQL)
def op13(spark: SparkSession, folder: str) -> DataFrame:
    return covertree.similar_vectors(read(spark, folder, "embeddings"))
