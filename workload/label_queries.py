"""Queries: labels, catalog joins, splits and example selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyforge.operators import samples as M
from tallyforge.operators import selection as X
from tallyforge.operators import splits as P
from tallyforge.operators import store as T
from tallyforge.operators.ordering import id_bucket, mixed_key, row_numbers
from workload import views as V
from workload.registry import query


def _order(column: str) -> str:
    return f"({column} % 2147483647) * 1103515245 % 2147483647, {column}"


_ORDER_TASK = _order("task_id")

# The split every label query uses: tasks by residue, so that it is cheap to state in SQL.
_SPLIT = "CASE task_id % 5 WHEN 3 THEN 'validation' WHEN 4 THEN 'test' ELSE 'train' END"


def _labelled(spark, d):
    return V.task_labels(spark, d).withColumn("split", F.expr(_SPLIT))


@query("used_catalog", "SELECT function_name, doc FROM catalog WHERE function_name IN (SELECT label FROM task_label_rows)",
       ("catalog", "task_label_rows"))
def used_catalog(spark, d):
    return M.used_catalog(V.view(spark, d, "catalog"), V.view(spark, d, "task_label_rows"))


@query("missing_labels", "SELECT DISTINCT label FROM task_label_rows WHERE label NOT IN (SELECT function_name FROM catalog)",
       ("catalog", "task_label_rows"))
def missing_labels(spark, d):
    return M.missing_labels(V.view(spark, d, "catalog"), V.view(spark, d, "task_label_rows"))


@query("unseen_labels", f"""
    WITH p AS (SELECT DISTINCT {_SPLIT.replace('task_id % 5', 'o_orderkey % 5')} AS split,
               concat('C', cast(o_custkey AS string)) AS label FROM orders)
    SELECT split, label FROM p WHERE split <> 'train' AND label NOT IN (SELECT label FROM p WHERE split = 'train')""")
def unseen_labels(spark, d):
    pairs = V.table(spark, d, "orders").selectExpr("o_orderkey AS task_id", "concat('C', o_custkey) AS label")
    return M.unseen_labels(pairs.withColumn("split", F.expr(_SPLIT)))


@query("label_distribution", f"""
    SELECT label, count(*) FILTER (WHERE s = 'train') AS train, count(*) FILTER (WHERE s = 'validation') AS validation,
           count(*) FILTER (WHERE s = 'test') AS test
    FROM (SELECT label, {_SPLIT} AS s FROM task_labels) GROUP BY label""", ("task_labels",))
def label_distribution(spark, d):
    prefixed = _labelled(spark, d).withColumn("label", F.concat(F.lit("root.std."), "label"))
    return M.label_distribution(prefixed, ["train", "validation", "test"])


_COLUMNS = ", ".join(f"max((label = 'L{i}')::INT) AS \"L{i}\"" for i in range(25))


@query("label_matrix", f"SELECT task_id, {_COLUMNS} FROM task_labels GROUP BY task_id", ("task_labels",))
def label_matrix(spark, d):
    pairs = V.view(spark, d, "task_label_rows")  # rows that come twice mark the same place
    return M.label_matrix(pairs, [f"L{i}" for i in range(25)])


@query("label_matrix_entries", """
    SELECT task_id, c - 1 AS column, label FROM task_labels JOIN
    (SELECT label, row_number() OVER (ORDER BY label) AS c FROM (SELECT DISTINCT label FROM task_labels)) USING (label)""", ("task_labels",))
def label_matrix_entries(spark, d):
    return M.label_matrix_entries(V.task_labels(spark, d))


@query("lookup_node_doc", """
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, node, coalesce(doc, 'No doc') AS doc FROM (
        SELECT *, concat('L', cast(l_partkey % 25 AS string)) AS node FROM lineitem) LEFT JOIN (
            SELECT concat('L', n_nationkey % 20) AS function_name, arg_min(n_name, -n_nationkey) AS doc FROM nation GROUP BY 1) ON node = function_name""")
def lookup_node_doc(spark, d):
    predicted = V.table(spark, d, "lineitem").selectExpr(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "concat(' L', l_partkey % 25, '\\n') AS node")
    catalog = V.table(spark, d, "nation").selectExpr(  # L0 to L4 twice
        "concat('L', n_nationkey % 20) AS function_name", "n_name AS doc", "-n_nationkey AS position")
    found = M.lookup_node_doc(predicted, catalog, "position")
    return found.withColumn("node", F.btrim("node", F.lit(" \n")))


@query("pool_order", "SELECT doc_id AS task_id, row_number() OVER (ORDER BY doc_id) - 1 AS line FROM documents")
def pool_order(spark, d):
    pool = V.table(spark, d, "documents").selectExpr("cast(doc_id AS string) AS task_id")
    numbered = row_numbers(pool.withColumn("task_id", F.col("task_id").cast("long")), [], ["task_id"],
                           id_bucket("task_id"), "line")
    return M.pool_order(numbered.withColumn("line", F.col("line") - 1))


# ---- set operations --------------------------------------------------------------------------

@query("merge_train_test", "SELECT doc_id, lang FROM documents WHERE lang <> 'en' UNION ALL SELECT doc_id, lang FROM documents WHERE lang = 'en'")
def merge_train_test(spark, d):
    docs = V.table(spark, d, "documents").select("doc_id", "lang")
    return T.union_experiments([docs.filter("lang <> 'en'"), docs.filter("lang = 'en'")])


@query("union_libraries", """
    SELECT function_name, doc, NULL AS source FROM catalog
    UNION ALL SELECT concat('P', cast(p_partkey AS string)), p_name, p_brand FROM part""", ("catalog",))
def union_libraries(spark, d):
    extra = V.table(spark, d, "part").selectExpr("concat('P', p_partkey) AS function_name", "p_name AS doc", "p_brand AS source")
    return T.union_experiments([V.view(spark, d, "catalog"), extra])


# ---- splits ----------------------------------------------------------------------------------

@query("kfold_split", f"SELECT doc_id, (row_number() OVER (ORDER BY {_order('doc_id')}) - 1) % 5 AS fold FROM documents")
def kfold_split(spark, d):
    return P.kfold_split(V.table(spark, d, "documents").select("doc_id"), "doc_id", 5, key=mixed_key("doc_id"))


@query("stratified_kfold", f"SELECT doc_id, lang, (row_number() OVER (PARTITION BY lang ORDER BY {_order('doc_id')}) - 1) % 5 AS fold FROM documents")
def stratified_kfold(spark, d):
    docs = V.table(spark, d, "documents").select("doc_id", "lang")
    return P.stratified_kfold(docs, "doc_id", "lang", 5, key=mixed_key("doc_id"))


@query("random_split", f"""
    WITH p AS (SELECT doc_id, row_number() OVER (ORDER BY {_order('doc_id')}) AS pos, count(*) OVER () AS n FROM documents),
    q AS (SELECT *, cast(ceil(n * 2 / 5) AS bigint) AS held FROM p)
    SELECT doc_id, CASE WHEN pos <= n - held THEN 'train' WHEN pos <= n - held + held // 2 THEN 'validation' ELSE 'test' END AS split FROM q""")
def random_split(spark, d):
    return P.random_split(V.table(spark, d, "documents").select("doc_id"), "doc_id", 0.4, key=mixed_key("doc_id"))


@query("multilabel_split", f"""
    WITH RECURSIVE s AS (SELECT label, count(*) AS size, row_number() OVER (ORDER BY count(*), label) AS rank FROM task_labels GROUP BY label),
    t AS (SELECT task_id, min(rank) AS rarest, bit_xor(('0x' || substr(md5(label), 1, 15))::BIGINT) AS code, list(rank) AS labels
          FROM task_labels JOIN s USING (label) GROUP BY task_id),
    p AS (SELECT *, row_number() OVER (PARTITION BY rarest ORDER BY code, {_ORDER_TASK}) AS pos, count(*) OVER (PARTITION BY rarest) AS grp FROM t),
    sets AS (SELECT rarest, grp, min(pos) - 1 AS start, max(pos) AS upto, unnest(any_value(labels)) AS rank FROM p GROUP BY rarest, grp, code),
    wanted AS (SELECT rank, least((size * 4 + 5) // 10, size - 1) AS wanted, coalesce(grp, 0) AS grp
               FROM s LEFT JOIN (SELECT DISTINCT rarest AS rank, grp FROM p) USING (rank)),
    turns AS (
        SELECT 0 AS turn, rank, 0::BIGINT AS held, 0::BIGINT AS test, 0::BIGINT AS hold, 0::BIGINT AS tests FROM s
        UNION ALL
        SELECT turn + 1, own.rank, held + coalesce(sum(upto * hold // grp - start * hold // grp), 0)::BIGINT,
               test + coalesce(sum((upto * hold // grp) * tests // greatest(hold, 1) - (start * hold // grp) * tests // greatest(hold, 1)), 0)::BIGINT, hold, tests
        FROM (SELECT turn, rank, held, test, hold, least(greatest(max(CASE WHEN rank = turn + 1 THEN wanted // 2 - test END) OVER (), 0), hold) AS tests
              FROM (SELECT turn, rank, held, test, wanted, least(greatest(max(CASE WHEN rank = turn + 1 THEN wanted - held END) OVER (), 0),
                           max(CASE WHEN rank = turn + 1 THEN grp END) OVER ()) AS hold FROM turns JOIN wanted USING (rank))) own
        LEFT JOIN sets ON sets.rarest = turn + 1 AND sets.rank = own.rank WHERE turn < (SELECT max(rank) FROM s)
        GROUP BY turn, own.rank, held, test, hold, tests),
    q AS (SELECT DISTINCT turn AS rarest, hold, tests FROM turns WHERE turn > 0)
    SELECT task_id, CASE WHEN pos * hold // grp = (pos - 1) * hold // grp THEN 'train'
        WHEN (pos * hold // grp) * tests // greatest(hold, 1) = ((pos - 1) * hold // grp) * tests // greatest(hold, 1) THEN 'validation' ELSE 'test' END AS split
    FROM p JOIN q USING (rarest)""", ("task_labels",))
def multilabel_split(spark, d):
    return P.multilabel_split(V.task_labels(spark, d), 0.4, key=mixed_key("task_id"))


# ---- selection -------------------------------------------------------------------------------

def _greedy_sql(k: int) -> str:
    """Greedy label coverage, one round per step; later rounds drop what is covered."""
    pairs = "pool AS (SELECT DISTINCT o_custkey AS task_id, concat('L', cast(l_partkey % 25 AS string)) AS label FROM lineitem JOIN orders ON o_orderkey = l_orderkey)"
    parts = [pairs, "r0 AS (SELECT NULL::BIGINT AS task_id, 0::BIGINT AS gain, 0 AS rank)"]
    for i in range(1, k + 1):
        seen = " UNION ALL ".join(f"SELECT task_id FROM r{j}" for j in range(i))
        parts.append(f"c{i} AS (SELECT DISTINCT label FROM pool WHERE task_id IN ({seen}))")
        parts.append(
            f"g{i} AS (SELECT task_id, count(*) FILTER (WHERE label NOT IN (SELECT label FROM c{i})) AS gain FROM pool "
            f"WHERE coalesce(task_id NOT IN (SELECT task_id FROM ({seen}) WHERE task_id IS NOT NULL), true) GROUP BY task_id)")
        parts.append(f"r{i} AS (SELECT task_id, gain, {i} AS rank FROM g{i} ORDER BY gain DESC, {_ORDER_TASK} LIMIT 1)")
    picks = " UNION ALL ".join(f"SELECT rank, task_id, gain FROM r{i}" for i in range(1, k + 1))
    return f"WITH {', '.join(parts)} {picks}"


@query("coverage_select", _greedy_sql(5))
def coverage_select(spark, d):
    lines = V.table(spark, d, "lineitem").join(V.table(spark, d, "orders"), F.col("o_orderkey") == F.col("l_orderkey"))
    pairs = lines.selectExpr("o_custkey AS task_id", "concat('L', l_partkey % 25) AS label")
    return X.coverage_select(pairs, 5, key=mixed_key)


_KNN = """knn AS (SELECT a.vec_id AS query_id, b.vec_id AS neighbor_id,
        round(sqrt(list_sum(list_transform(list_zip(a.e, b.e), lambda p: (p[1] - p[2]) * (p[1] - p[2])))), 6) AS distance
        FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings) a JOIN (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings) b
        ON a.vec_id <> b.vec_id),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbor_id) AS rank FROM knn)"""


def vectors(spark, d):
    return V.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


@query("knn_topk", f"WITH {_KNN} SELECT query_id, neighbor_id, distance, cast(rank AS int) AS rank FROM ranked WHERE rank <= 10")
def knn_topk(spark, d):
    points = vectors(spark, d).select("id", "vector")
    return X.knn_topk(points, points, 10, exclude_self=True)


@query("similarity_select", f"""
    WITH {_KNN} SELECT query_id, neighbor_id, distance, cast(rank AS int) AS rank, label FROM ranked
    JOIN embeddings ON vec_id = neighbor_id WHERE rank <= 5""")
def similarity_select(spark, d):
    points = vectors(spark, d)
    return X.similarity_select(points.select("id", "vector"), points, 5, exclude_self=True)


@query("build_chunk_index", """
    SELECT doc_id AS chunk_id, lang AS corpus, 256 AS dims,
           CASE WHEN regexp_matches(text, '[A-Za-z0-9_]') THEN 1.0::DOUBLE ELSE 0.0 END AS norm FROM documents""")
def build_chunk_index(spark, d):
    chunks = V.view(spark, d, "chunks").select("chunk_id", "corpus", "content")
    return X.build_chunk_index(chunks).select(
        "chunk_id", "corpus", F.size("vector").alias("dims"),
        F.round(F.aggregate("vector", F.lit(0.0), lambda a, v: a + v * v), 4).alias("norm"))


@query("filter_corpus_files", """
    SELECT doc_id, file FROM (SELECT doc_id, concat('docs/', lang, '/', source, '.md') AS file FROM documents)
    WHERE upper(string_split(file, '/')[-1]) IN ('SRC1.MD', 'SRC7.MD')""")
def filter_corpus_files(spark, d):
    chunks = V.table(spark, d, "documents").selectExpr("doc_id", "concat('docs/', lang, '/', source, '.md') AS file")
    return X.filter_corpus_files(chunks, ["Src1.md", "SRC7.MD"])


def _leading(k: int, matrix: str) -> str:
    """The direction of a covariance matrix's largest eigenvalue: repeated squaring leaves nothing else."""
    return f"""power{k} AS (
        SELECT 0 AS step, m FROM {matrix} UNION ALL
        SELECT step + 1, [[x / trace FOR x IN r] FOR r IN sq] FROM (
            SELECT step, sq, list_sum([sq[i][i] FOR i IN range(1, len(sq) + 1)]) AS trace FROM (
                SELECT step, [[list_inner_product(a, b) FOR b IN m] FOR a IN m] AS sq FROM power{k} WHERE step < 16))),
    column{k} AS (SELECT m[list_position(d, list_max(d))] AS r FROM (SELECT m, [m[i][i] FOR i IN range(1, len(m) + 1)] AS d FROM power{k} WHERE step = 16)),
    axis{k} AS (SELECT [x / sqrt(list_inner_product(r, r)) FOR x IN r] AS v FROM column{k})"""


@query("pca_2d", f"""
    WITH RECURSIVE long AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
    means AS (SELECT i, avg(x) AS mean FROM long GROUP BY i),
    centred AS (SELECT vec_id, i, x - mean AS x FROM long JOIN means USING (i)),
    entries AS (SELECT a.i, b.i AS j, sum(a.x * b.x) AS s FROM centred a JOIN centred b ON a.vec_id = b.vec_id GROUP BY a.i, b.i),
    cov AS (SELECT list(r ORDER BY i) AS m FROM (SELECT i, list(s ORDER BY j) AS r FROM entries GROUP BY i)),
    {_leading(1, "cov")},
    rest AS (SELECT [[m[i][j] - strength * v[i] * v[j] FOR j IN range(1, len(m) + 1)] FOR i IN range(1, len(m) + 1)] AS m FROM (
        SELECT m, v, list_inner_product(v, [list_inner_product(r, v) FOR r IN m]) AS strength FROM cov, axis1)),
    {_leading(2, "rest")},
    rows AS (SELECT vec_id, list(x ORDER BY i) AS e FROM centred GROUP BY vec_id)
    SELECT vec_id AS id, CASE WHEN label < 5 THEN 'low' ELSE 'high' END AS dataset, round(abs(list_inner_product(e, axis1.v)), 4) AS pc1,
        round(abs(list_inner_product(e, axis2.v)), 4) AS pc2 FROM rows JOIN embeddings USING (vec_id), axis1, axis2""")
def pca_2d(spark, d):
    named = {"low": vectors(spark, d).filter("label < 5"), "high": vectors(spark, d).filter("label >= 5")}
    projected = X.pca_2d(X.stack_datasets(named).select("id", "dataset", "vector"))
    return projected.select("id", "dataset", F.round(F.abs("pc1"), 4).alias("pc1"), F.round(F.abs("pc2"), 4).alias("pc2"))
