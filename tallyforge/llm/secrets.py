"""Secret scans over a trigram inverted index.

From each rule's regular expression a Boolean trigram query is derived: alternatives of
sets of trigrams, at least one of which must stand in a text, whole, for the rule to match.
The index has a posting (trigram, text) for the trigrams that queries mention.  Intersecting
the postings gives each rule's candidates, and only those are verified; a rule without
mandatory trigrams is run on every text.

Texts are folded to lower case for the index, so one index serves rules of either case.
Postings carry a key of the text, not of the row: copies share their postings.
Everything is DataFrame operations.
"""

from __future__ import annotations

import re._constants as _op
import re._parser as _parser
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.session import known_size, materialize


@dataclass(frozen=True)
class Rule:
    """``pattern`` is matched from left to right without overlap; matches fail whose ``group`` (0: all) is shorter than ``least``."""
    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    any_case: bool = False


# The base rules, in the order in which equal starts are listed.
RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]+", 0, 32),
)

_MOST_STRINGS = 64  # of an alternative set that is multiplied out; beyond it the parts count one by one


# ---- queries ----

def _all_of(strings: set[str]) -> set[frozenset[str]]:
    """The query of "one of these strings occurs"."""
    return {frozenset(s[i:i + 3] for i in range(len(s) - 2)) for s in strings}


def _both(a: set[frozenset[str]], b: set[frozenset[str]]) -> set[frozenset[str]]:
    return _least({x | y for x in a for y in b})


def _least(query: set[frozenset[str]]) -> set[frozenset[str]]:
    """Alternatives that contain another one say nothing more."""
    return {x for x in query if not any(y < x for y in query)}


def _derive(node) -> tuple[set[str] | None, set[frozenset[str]]]:
    """(all strings the part can be, if few, and no query) or (None, what must occur in it).

    The query {()} asks nothing.  Along a sequence, strings are joined as long as they are few;
    where that ends, what was joined so far becomes part of the query.
    """
    run: set[str] = {""}
    query: set[frozenset[str]] = {frozenset()}
    whole = True
    for kind, value in node:
        part: set[str] | None = None
        own: set[frozenset[str]] = {frozenset()}
        if kind is _op.LITERAL:
            part = {chr(value).lower()}
        elif kind is _op.AT:
            part = {""}
        elif kind is _op.SUBPATTERN:
            part, own = _derive(value[3])
        elif kind is _op.BRANCH:
            options = [_derive(x) for x in value[1]]
            if all(e is not None for e, _ in options) and sum(len(e) for e, _ in options) <= _MOST_STRINGS:
                part = set().union(*[e for e, _ in options])
            own = _least(set().union(*[q if e is None else _all_of(e) for e, q in options]))
        elif kind in (_op.MAX_REPEAT, _op.MIN_REPEAT, _op.POSSESSIVE_REPEAT):
            low, high, inner = value
            once, q = _derive(inner)
            if (low, high) == (0, 1):
                part = None if once is None else once | {""}
            elif low:
                own = q if once is None else _all_of(once)
        if part is not None and len(run) * len(part) <= _MOST_STRINGS:
            run = {a + b for a in run for b in part}
            continue
        whole = False
        query = _both(_both(query, _all_of(run)), own)
        run = part if part is not None else {""}  # a gap: strings before and behind it don't touch
    return (run, {frozenset()}) if whole else (None, _both(query, _all_of(run)))


def trigram_query(pattern: str) -> set[frozenset[str]] | None:
    """Alternative sets of lower-case trigrams one of which must occur, whole; None if none is mandatory."""
    exact, query = _derive(_parser.parse(pattern))
    query = _least(_all_of(exact) if exact is not None else query)
    return None if frozenset() in query else query


# ---- index ----

def text_key(text: Column) -> Column:
    """Key of a text in the index.  Two texts that share one by chance only share candidates, which are verified."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def build_index(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """Postings ``trigram``, ``key`` of all texts, for the given trigrams; copies of a text give one posting."""
    folded = F.lower(F.col("text"))
    present = F.array_compact(F.array(*[F.when(F.contains(folded, F.lit(t)), F.lit(t)) for t in trigrams]))
    return docs.select(text_key(F.col("text")).alias("key"), F.explode(present).alias("trigram")).distinct()


def candidates(postings: DataFrame, queries: dict[str, set[frozenset[str]]]) -> DataFrame:
    """``key`` and a flag per rule: the texts whose postings fulfil at least one rule's query."""
    names = sorted({t for q in queries.values() for alternative in q for t in alternative})
    has = postings.groupBy("key").agg(*[F.bool_or(F.col("trigram") == t).alias(f"t{i}") for i, t in enumerate(names)])

    def holds(query: set[frozenset[str]]) -> Column:
        found = F.lit(False)
        for alternative in sorted(query, key=sorted):
            every = F.lit(True)
            for t in sorted(alternative):
                every = every & F.col(f"t{names.index(t)}")
            found = found | every
        return found

    flags = has.select("key", *[holds(q).alias(f"may_{kind}") for kind, q in queries.items()])
    any_flag = F.lit(False)
    for kind in queries:
        any_flag = any_flag | F.col(f"may_{kind}")
    return flags.filter(any_flag)


# ---- verification ----

_OPEN, _SHUT, _OTHER = "\x01", "\x02", "\x03"


def spans_of(text: Column, rule: Rule) -> Column:
    """Valid matches of a rule in a text as (start, end) in code points.

    The text is matched once, with marks around each match; the pieces between marks
    are then added up.  Marks that stand in the text are replaced by another control character first.
    """
    pattern = f"(?i){rule.pattern}" if rule.any_case else rule.pattern
    # A match of one run of a class is valid from `least` characters on, which the pattern itself may as well say.
    run = rule.pattern[:-1] if rule.group == 0 and _is_run(rule.pattern) else None
    marking = f"{run}{{{rule.least},}}" if run else pattern
    clean = F.when(F.contains(text, F.lit(_OPEN)) | F.contains(text, F.lit(_SHUT)),
                   F.translate(text, _OPEN + _SHUT, _OTHER * 2)).otherwise(text)
    pieces = F.split(F.regexp_replace(clean, F.lit(marking), F.lit(f"{_OPEN}$0{_SHUT}")), f"[{_OPEN}{_SHUT}]", -1)
    start = F.struct(F.lit(0).alias("at"), F.lit(False).alias("inside"), F.array().cast("array<struct<start:int,end:int>>").alias("found"))

    def step(state: Column, piece: Column) -> Column:
        end = state["at"] + F.char_length(piece)
        value = F.regexp_extract(piece, pattern, rule.group) if rule.group else piece
        ok = state["inside"] & (F.char_length(value) >= rule.least)
        span = F.array(F.struct(state["at"].alias("start"), end.alias("end")))
        return F.struct(end.alias("at"), (~state["inside"]).alias("inside"),
                        F.when(ok, F.concat(state["found"], span)).otherwise(state["found"]).alias("found"))

    return F.aggregate(pieces, start, step)["found"]


def _numbered(rank: int, kind: str) -> Callable[[Column], Column]:
    """Span to (start, rank of its rule, end, kind), which sorts as listed."""
    return lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"), F.lit(kind).alias("kind"))


def _is_run(pattern: str) -> bool:
    """One character class, repeated: its longest runs are its matches."""
    node = list(_parser.parse(pattern))
    return len(node) == 1 and node[0][0] is _op.MAX_REPEAT and node[0][1][:2] == (1, _op.MAXREPEAT) and node[0][1][2][0][0] is _op.IN


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``doc_id``, ``n_<kind>`` for each rule, ``base_sha256`` and ``spans`` of every row.

    ``spans`` lists kind:start:end by start, then in the order of the rules, joined by commas;
    ``base_sha256`` is its SHA-256 (the base rules are all there are here).  A null or empty
    text has no match.  Repeated rows are kept; other columns are not read.
    """
    queries = {r.kind: trigram_query(r.pattern) for r in rules}
    indexed = {k: q for k, q in queries.items() if q}
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    if indexed:
        trigrams = sorted({t for q in indexed.values() for alternative in q for t in alternative})
        found = known_size(candidates(materialize(build_index(texts, trigrams), "trigram-postings"), indexed), "secret-candidates")
        texts = texts.withColumn("key", text_key(F.col("text"))).join(found, "key", "left")
    none = F.array().cast("array<struct<start:int,end:int>>")
    columns = []
    for rule in rules:
        spans = spans_of(F.col("text"), rule)
        columns.append((F.when(F.col(f"may_{rule.kind}"), spans).otherwise(none) if rule.kind in indexed else spans).alias(f"s_{rule.kind}"))
    each = texts.select("doc_id", *columns)
    listed = F.array_sort(F.concat(*[
        F.transform(f"s_{r.kind}", _numbered(i, r.kind)) for i, r in enumerate(rules)]))
    joined = F.array_join(F.transform(listed, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    counted = each.select("doc_id", *[F.size(f"s_{r.kind}").cast("long").alias(f"n_{r.kind}") for r in rules], joined.alias("spans"))
    return counted.withColumn("base_sha256", F.sha2(F.col("spans").cast("binary"), 256))
