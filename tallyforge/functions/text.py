"""Text extraction as Column expressions; everything stays inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FENCE = "```"

# Patterns and texts the results depend on.
ANSI_ESCAPE = r"\x1B(?:[@-Z\\-_]|\[[0-?]*[ -/]*[@-~])"
COMMENT = r"(?dm)(?://|#).*$"
FUNCTION_HEADER = r'func\(\s*(?:doc:\s*".*?"\s*)?\)\s*\w+\s*\{'
TESTS_HEADER = r"module\s*\([^)]*\)\s*tests\s*\{"
SIGNATURE_SPAN = r"(?s)func\(.*?\{.*?\}"
LAYOUT_NODE = (r"\b(\w+)\(x:\s*([-+]?\d+(?:\.\d+)?),\s*y:\s*([-+]?\d+(?:\.\d+)?)"
               r'(?:,\s*name\s*(?::|=)\s*"(.*?)")?\)')
ASSERTION = r'(?d)^assert\s+([\w_]+)\((.*?)\)\s*==\s*(True|False|\d+|\[.*?\]|".*?")'
TRUNCATION_NOTE = "\n (code has been truncated)...."
NOT_FOUND = "Not found"

DEFAULT_FENCE_TAG = r"mid\w*"

_SPACE = " \t\n\r\f\x0b"
_LINE_BREAK = r"\r\n|\n|\r"


def strip(text: Column) -> Column:
    """Remove leading and trailing white space, line breaks included."""
    return F.btrim(text, F.lit(_SPACE))


def lines_of(text: Column) -> Column:
    return F.split(text, _LINE_BREAK)


def clean_ansi(text: Column) -> Column:
    return strip(F.regexp_replace(text, ANSI_ESCAPE, ""))


def error_lines(text: Column) -> Column:
    """Stripped lines that mention an error; null or empty text gives an empty array."""
    lines = F.split(clean_ansi(F.coalesce(text, F.lit(""))), "\n")
    return F.transform(F.filter(lines, lambda s: F.lower(s).contains("error")), strip)


def response_code(text: Column, last_snippet: Column | bool = False, tag: str = DEFAULT_FENCE_TAG) -> Column:
    """Program text of a model response: chosen fenced block without comments.

    The last block is taken on request or when a thinking section was left open,
    otherwise the first; without any block the whole section is used.
    """
    section = F.substring_index(text, "</think>", -1)
    blocks = F.regexp_extract_all(section, F.lit(rf"(?s){FENCE}{tag}(.*?)({FENCE}|$)"), F.lit(1))
    unfinished = text.contains("<think>") & ~text.contains("</think>")
    want_last = F.lit(last_snippet) if isinstance(last_snippet, bool) else last_snippet
    chosen = F.when(want_last | unfinished, F.try_element_at(blocks, F.lit(-1))).otherwise(
        F.try_element_at(blocks, F.lit(1)))
    return strip(F.regexp_replace(F.coalesce(chosen, section), COMMENT, ""))


def fenced_block(text: Column, tag: str = DEFAULT_FENCE_TAG) -> Column:
    """First closed fenced block, or the whole text, stripped."""
    blocks = F.regexp_extract_all(text, F.lit(rf"(?s){FENCE}{tag}(.*?){FENCE}"), F.lit(1))
    return strip(F.coalesce(F.try_element_at(blocks, F.lit(1)), text))


def _closing_brace(rest: Column) -> Column:
    """Length of ``rest`` up to and including the brace that closes an already open one.

    Null if it is never closed.  Folds over the runs that end in a brace, so the
    cost is linear in the text.
    """
    runs = F.regexp_extract_all(rest, F.lit(r"[^{}]*[{}]"), F.lit(0))

    def step(state: Column, run: Column) -> Column:
        change = F.when(F.endswith(run, F.lit("{")), 1).otherwise(-1)
        return F.when(state["depth"] == 0, state).otherwise(
            F.struct((state["depth"] + change).alias("depth"),
                     (state["length"] + F.length(run)).alias("length")))

    start = F.struct(F.lit(1).alias("depth"), F.lit(0).alias("length"))
    return F.aggregate(runs, start, step,
                       lambda state: F.when(state["depth"] == 0, state["length"]))


def function_block(code: Column) -> Column:
    """Body of the first function; an unclosed body loses its last character."""
    rest = F.regexp_extract(code, rf"(?s){FUNCTION_HEADER}(.*)\z", 1)
    length = F.coalesce(_closing_brace(rest), F.length(rest))
    return F.substr(rest, F.lit(1), F.greatest(length - 1, F.lit(0)))


def tests_module(code: Column) -> Column:
    """The balanced ``tests`` module with its header, or an empty string."""
    header = F.regexp_extract(code, TESTS_HEADER, 0)
    rest = F.regexp_extract(code, rf"(?s){TESTS_HEADER}(.*)\z", 1)
    length = _closing_brace(rest)
    block = F.when(F.length(header) > 0, F.concat(header, F.substr(rest, F.lit(1), length)))
    return F.coalesce(block, F.lit(""))


def signature(code: Column) -> Column:
    """Header of the first function plus its top-level ``in(``/``out(`` lines."""
    span = F.regexp_extract(code, SIGNATURE_SPAN, 0)

    def count(line: Column, brace: str) -> Column:
        return F.length(line) - F.length(F.replace(line, F.lit(brace), F.lit("")))

    def step(state: Column, line: Column) -> Column:
        bare = F.ltrim(line)
        port = bare.startswith("in(") | bare.startswith("out(")
        keep = F.isnull(state["kept"]) | ((state["depth"] == 1) & port)
        kept = F.when(keep, F.concat(F.coalesce(state["kept"], F.array().cast("array<string>")), F.array(line))
                      ).otherwise(state["kept"])
        return F.struct((state["depth"] + count(line, "{") - count(line, "}")).alias("depth"),
                        kept.alias("kept"))

    start = F.struct(F.lit(0).alias("depth"), F.lit(None).cast("array<string>").alias("kept"))
    kept = F.aggregate(lines_of(span), start, step, lambda state: state["kept"])
    closed = F.when(strip(F.element_at(kept, -1)) == "}", kept).otherwise(F.concat(kept, F.array(F.lit("}"))))
    return F.when(F.length(span) > 0, F.array_join(closed, "\n")).otherwise(NOT_FOUND)


def inline_signature(code: Column) -> Column:
    """Signature with the indentation after each line break turned into one tab."""
    return F.regexp_replace(signature(code), r"\n\s+", "\n\t")


def layout_nodes(code: Column) -> Column:
    """All placed nodes of a program as ``array<struct<type, x, y, name>>``."""
    parts = [F.regexp_extract_all(code, F.lit(LAYOUT_NODE), F.lit(i)) for i in (1, 2, 3, 4)]
    zipped = F.arrays_zip(*[p.alias(n) for p, n in zip(parts, ("t", "x", "y", "n"))])
    return F.transform(zipped, lambda z: F.struct(
        z["t"].alias("type"), z["x"].cast("double").alias("x"), z["y"].cast("double").alias("y"),
        F.nullif(z["n"], F.lit("")).alias("name")))


def doc_args(content: Column) -> Column:
    """Last word of every line that starts with ``in`` or ``out``, without end punctuation."""
    stripped = F.transform(lines_of(content), strip)
    ports = F.filter(stripped, lambda s: s.startswith("in") | s.startswith("out"))
    return F.transform(ports, lambda s: F.btrim(F.element_at(F.split(s, r"\s+"), -1), F.lit(".,;:")))


def truncate_text(text: Column, max_chars: Column | int) -> Column:
    """Cut to ``max_chars`` and back to the last sentence end or line break."""
    limit = F.lit(max_chars) if isinstance(max_chars, int) else max_chars
    head = F.substr(text, F.lit(1), limit)
    sentence = F.regexp_extract(head, r"(?ds)^(.*?[.\n])[^.\n]*$", 1)
    return (F.when(F.length(text) <= limit, text)
            .when(F.length(sentence) > 0, strip(sentence))
            .otherwise(F.concat(strip(head), F.lit(TRUNCATION_NOTE))))


def close_fences(text: Column) -> Column:
    """Append a closing fence when the number of fence marks is odd."""
    marks = (F.length(text) - F.length(F.replace(text, F.lit(FENCE), F.lit("")))) / F.lit(len(FENCE))
    return F.when(marks.cast("int") % 2 != 0, F.concat(text, F.lit("\n" + FENCE))).otherwise(text)


def split_labels(labels: Column) -> Column:
    """Comma list to an array of stripped labels."""
    return F.transform(F.split(labels, ","), strip)


def parsed_assertion(assertion: Column) -> Column:
    """``struct<function, input, kind, expected>`` or null when the text does not match.

    ``kind`` is bool, int, list or string; the expected value stays text, with the
    quotes of a string removed.
    """
    expected = F.regexp_extract(assertion, ASSERTION, 3)
    kind = (F.when(F.lower(expected).isin("true", "false"), "bool")
            .when(expected.rlike(r"^\d+$"), "int")
            .when(expected.startswith("["), "list")
            .otherwise("string"))
    value = (F.when(kind == "bool", F.lower(expected))
             .when(kind == "string", F.btrim(expected, F.lit('"')))
             .otherwise(expected))
    return F.when(assertion.rlike(ASSERTION), F.struct(
        F.regexp_extract(assertion, ASSERTION, 1).alias("function"),
        F.concat(F.lit("("), F.regexp_extract(assertion, ASSERTION, 2), F.lit(")")).alias("input"),
        kind.alias("kind"), value.alias("expected")))


def parsed_assertions(assertions: Column) -> Column:
    """Parsed forms of an array of assertions in order, non-matching ones dropped."""
    return F.filter(F.transform(assertions, parsed_assertion), lambda a: a.isNotNull())


# Pieces of a literal: strings (a run of text without a closing quote is one too), brackets and commas, and what lies between.
_LITERAL_PIECES = r"""(?s)"(?:[^"\\]|\\.)*"?|'(?:[^'\\]|\\.)*'?|[\[\](){},]|[^"'\[\](){},]+"""


def _json_string(piece: Column) -> Column:
    """A quoted string in JSON's form; escapes that JSON doesn't know stay and make it unreadable."""
    inner = F.substr(piece, F.lit(2), F.length(piece) - 2)
    plain = F.regexp_replace(F.replace(inner, F.lit("\\'"), F.lit("'")), r"\\x([0-9a-fA-F]{2})", r"\\u00$1")
    quoted = F.regexp_replace(plain, r'(?<!\\)((?:\\\\)*)"', r'$1\\"')
    return F.concat(F.lit('"'), F.when(piece.startswith("'"), quoted).otherwise(plain), F.lit('"'))


def literal_json(text: Column) -> Column:
    """JSON text of a Python literal: tuples become arrays, names and numbers get JSON's form.

    A pair of parentheses around one value is no tuple.  What JSON can't express (sets, keys that aren't
    strings, expressions) gives text that isn't JSON.
    """
    def word(piece: Column) -> Column:
        for name, value in (("True", "true"), ("False", "false"), ("None", "null")):
            piece = F.regexp_replace(piece, rf"\b{name}\b", value)
        piece = F.regexp_replace(piece, r"(?<![\w.])\.(\d)", "0.$1")
        return F.regexp_replace(piece, r"(?<![\w.])(\d+)\.(?!\d)", "$1.0")

    # The fold keeps what is written so far and, for each open bracket, where it stands and whether a comma is directly in it.
    start = F.struct(F.array().cast("array<string>").alias("out"), F.array().cast("array<struct<at:int,comma:boolean>>").alias("open"))

    def set_at(items: Column, at: Column, value: Column) -> Column:
        return F.transform(items, lambda x, i: F.when(i == at, value).otherwise(x))

    def step(state: Column, raw: Column) -> Column:
        out, opened = state["out"], state["open"]
        piece = F.btrim(raw, F.lit(_SPACE))
        top = F.get(opened, F.size(opened) - 1)
        last = F.get(out, F.size(out) - 1)
        # A trailing comma goes.
        kept = F.when(last == ",", F.slice(out, 1, F.size(out) - 1)).otherwise(out)
        tuple_ = top["comma"] | (F.size(out) - 1 == top["at"])
        closing = (F.when(piece != ")", F.concat(kept, F.array(piece)))
                   .when(tuple_, F.concat(set_at(kept, top["at"], F.lit("[")), F.array(F.lit("]"))))
                   .otherwise(set_at(kept, top["at"], F.lit(""))))
        shut = F.slice(opened, 1, F.greatest(F.size(opened) - 1, F.lit(0)))
        commas = F.transform(opened, lambda o, i: F.struct(o["at"].alias("at"), (o["comma"] | (i == F.size(opened) - 1)).alias("comma")))
        value = F.when(piece.startswith('"') | piece.startswith("'"), _json_string(piece)).otherwise(word(piece))
        fresh = F.array(F.struct(F.size(out).alias("at"), F.lit(False).alias("comma")))
        return (F.when(piece == "", state)
                .when(piece.isin("(", "[", "{"), F.struct(F.concat(out, F.array(piece)).alias("out"), F.concat(opened, fresh).alias("open")))
                .when(piece.isin(")", "]", "}"), F.struct(F.when(top.isNull(), F.concat(out, F.array(piece))).otherwise(closing).alias("out"), shut.alias("open")))
                .when(piece == ",", F.struct(F.concat(out, F.array(piece)).alias("out"), commas.alias("open")))
                .otherwise(F.struct(F.concat(out, F.array(value)).alias("out"), opened.alias("open"))))

    pieces = F.regexp_extract_all(text, F.lit(_LITERAL_PIECES), F.lit(0))
    folded = F.array_join(F.aggregate(pieces, start, step)["out"], "")

    # Most literals need no fold: numbers, names and lists, plain strings, and such arguments in one pair of parentheses.
    def flat(value: Column) -> Column:
        return word(F.regexp_replace(value, r",\s*\]", "]"))

    inner = F.substr(text, F.lit(2), F.length(text) - 2)
    outside = F.regexp_replace(inner, r"\[[^\[\]]*\]", "")
    arguments = (F.when(F.btrim(inner, F.lit(_SPACE)) == "", "[]")
                 .when(F.contains(outside, F.lit(",")), F.concat(F.lit("["), flat(F.regexp_replace(inner, r",\s*$", "")), F.lit("]")))
                 .otherwise(flat(inner)))
    return (F.when(text.rlike(r"""^[^"'(){}]*$"""), flat(text))
            .when(text.rlike(r'^"[^"\\]*"$'), text)
            .when(text.rlike(r"""^\([^"'(){}]*\)$""") & ~outside.rlike(r"[\[\]]"), arguments)
            .otherwise(folded))


def literal_value(text: Column) -> Column:
    """VARIANT of a Python literal, null if it can't be read."""
    # In an array: the parser would take the beginning of a text for the whole.
    return F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), literal_json(text), F.lit("]"))), "$[0]", "variant")


def typed_case(assertion: Column) -> Column:
    """``struct<function, input, expected_output>`` with both values as VARIANT, or null when the text does not match.

    One argument is the input itself, several are an array.  An input that can't be read is an array of its text, such an
    expected value is its text without quotes.
    """
    arguments, expected = (F.regexp_extract(assertion, ASSERTION, i) for i in (2, 3))
    inputs = F.coalesce(literal_value(F.concat(F.lit("("), arguments, F.lit(")"))), F.parse_json(F.to_json(F.array(strip(arguments)))))
    text = F.btrim(expected, F.lit('"'))
    quoted = F.element_at(F.split(F.to_json(F.named_struct(F.lit("v"), text)), '"v":', 2), 2)
    value = F.coalesce(literal_value(expected),
                       F.parse_json(F.substr(quoted, F.lit(1), F.length(quoted) - 1)))
    return F.when(assertion.rlike(ASSERTION), F.struct(
        F.regexp_extract(assertion, ASSERTION, 1).alias("function"), inputs.alias("input"), value.alias("expected_output")))


def typed_cases(assertions: Column) -> Column:
    """Test cases of an array of assertions in order, non-matching ones dropped."""
    return F.filter(F.transform(assertions, typed_case), lambda c: c.isNotNull())
