"""Personal data: regular expressions propose spans, checks confirm them, nearby words move the score.

Every kind has a score from which its spans are kept. The four base kinds are kept at any score; of the added ones a
contrary word nearby takes a span below it.

Everything is built from Spark's own functions and runs where the documents are; nothing is shuffled. A text is
split at the matches of a pattern; the lengths of the parts between give each match's place in code points.

Every loop in a pattern that could run over a long text is possessive, so Java neither recurses nor goes back,
and a match can only begin where a run of its characters begins, so one long run costs linear time.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table, text_of

#: Matches whose lengths are summed together; keeps the running sums of a text with many matches cheap.
BLOCK = 512
#: Code points before and after a match in which context words count.
CONTEXT_BEFORE, CONTEXT_AFTER = 40, 20
#: Added or taken when a helping or a contrary word stands near.
CONTEXT_STEP = 0.2


@dataclass(frozen=True)
class Kind:
    """What proposes and confirms spans of one kind. A text without hint can't match."""

    name: str
    pattern: str
    hint: str
    base_score: float
    least_score: float
    helps: str
    denies: str


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(value: Column) -> Column:
    """True if the digits of value pass Luhn's check."""
    d = _digits(value)
    n = F.length(d)

    def add(total: Column, i: Column) -> Column:
        x = F.substring(d, i, F.lit(1)).cast("int")
        twice = F.when((n - i) % 2 == 1, 2 * x).otherwise(x)
        return total + F.when(twice > 9, twice - 9).otherwise(twice)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


def mod97(value: Column) -> Column:
    """True if an account number passes ISO 7064's mod 97-10: country and check digits go last, letters count from 10."""
    v = F.regexp_replace(value, " ", "")
    v = F.concat(F.substr(v, F.lit(5)), F.substring(v, 1, 4))

    def step(rest: Column, i: Column) -> Column:
        c = F.substring(v, i, F.lit(1))
        code = F.ascii(c)
        return F.when(code < 58, (rest * 10 + code - 48) % 97).otherwise((rest * 100 + code - 55) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(v)), F.lit(0), step) == 1


def _valid_ip(value: Column) -> Column:
    plain = F.transform(F.split(value, r"\."), lambda x: F.regexp_replace(x, "^0+", ""))
    return F.forall(plain, lambda x: (F.length(x) < 3) | ((F.length(x) == 3) & (F.coalesce(x.try_cast("int"), F.lit(999)) <= 255)))


def _valid_ssn(value: Column) -> Column:
    return ~F.substring(value, 1, 3).isin("000", "666") & (F.substring(value, 1, 1) != "9") & (F.substring(value, 5, 2) != "00") & (F.substring(value, 8, 4) != "0000")


CHECKS = {
    "email": lambda v: F.lit(True),
    "ip": _valid_ip,
    "card": lambda v: F.when(F.length(_digits(v)).between(13, 19), luhn(v)).otherwise(False),
    "phone": lambda v: F.length(_digits(v)).between(9, 15),
    "iban": lambda v: F.when(F.length(F.regexp_replace(v, " ", "")).between(15, 34), mod97(v)).otherwise(False),
    "ssn": _valid_ssn,
}

KINDS = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", 0.8, 0.0, "mail|contact|write|e-mail", "example"),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", ".", 0.6, 0.0, "ip|host|server|address|login", "version|section|release"),
    Kind("card", r"[0-9]++(?:[\x20-][0-9]++)*+", "", 0.7, 0.0, "card|visa|credit|payment|carte|karte|tarjeta", "order|serial|isbn"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "+", 0.6, 0.0, "phone|tel|call|mobile|fax", "score|offset"),
    Kind("iban", r"\b[A-Z]{2}[0-9]{2}(?:(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?|[A-Z0-9]{11,30})\b", "", 0.8, 0.7, "iban|account|bank|konto|compte|cuenta", "sample"),
    Kind("ssn", r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b", "-", 0.5, 0.4, "ssn|social|security", "part|serial|order"),
)
BASE = tuple(k.name for k in KINDS[:4])


def _located(kind: Kind) -> Column:
    """Spans of one kind from the columns v_<kind> (matches) and p_<kind> (the parts between them), in order of start.

    Ends are running sums, made in blocks: a list of blocks, each with its last end and its (index, end) pairs.
    """
    v, p = F.col(f"v_{kind.name}"), F.col(f"p_{kind.name}")
    last = F.size(v) - 1

    def add(a: Column, i: Column) -> Column:
        end = (a["pos"] + F.char_length(p[i]) + F.char_length(v[i])).cast("long")
        return F.struct(end.alias("pos"), F.concat(a["ends"], F.array(F.struct(i.alias("i"), end.alias("end")))).alias("ends"))

    none = F.expr("cast(array() as array<struct<i:int,end:bigint>>)")
    start = lambda pos: F.struct(pos.alias("pos"), none.alias("ends"))

    def block(done: Column, b: Column) -> Column:
        own = F.sequence(b * BLOCK, F.least(b * BLOCK + (BLOCK - 1), last))
        return F.concat(done, F.array(F.aggregate(own, start(F.element_at(done, -1)["pos"]), add)))

    blocks = F.sequence(F.lit(0), F.floor(last / BLOCK).cast("int"))
    ends = F.flatten(F.transform(F.aggregate(blocks, F.array(start(F.lit(0).cast("long"))), block), lambda x: x["ends"]))

    def span(e: Column) -> Column:
        value = v[e["i"]]
        near = F.lower(F.concat(F.right(p[e["i"]], F.lit(CONTEXT_BEFORE)), F.lit(" "), F.left(p[e["i"] + 1], F.lit(CONTEXT_AFTER))))
        step = F.when(near.rlike(rf"\b(?:{kind.helps})"), CONTEXT_STEP).when(near.rlike(rf"\b(?:{kind.denies})"), -CONTEXT_STEP).otherwise(0.0)
        return F.struct(
            F.lit(kind.name).alias("kind"), (e["end"] - F.char_length(value)).alias("start"), e["end"].alias("end"), value.alias("value"),
            F.round(F.least(F.lit(1.0), F.lit(kind.base_score) + step), 2).alias("score"),
        )

    spans = F.filter(F.transform(ends, span), lambda s: CHECKS[kind.name](s["value"]) & (s["score"] >= kind.least_score))
    empty = F.expr("cast(array() as array<struct<kind:string,start:bigint,end:bigint,value:string,score:double>>)")
    return F.when(F.size(v) > 0, spans).otherwise(empty)


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id and spans, array<struct<kind, start, end, value, score>>.

    Spans are in order of kind, then start; places are code points, end exclusive. Null and empty texts have
    none. Spans of different kinds may overlap. Matches that fail their check are dropped without a second try.
    The four base kinds stay whatever their score; iban and ssn go where a contrary word stands near. Repeated rows are
    searched one by one, also those with equal or null ids. Other columns are ignored; an empty table gives an empty result.
    """
    nothing = F.expr("cast(array() as array<string>)")
    text = F.col("text")
    own = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    # in steps, so that Catalyst keeps every array as a column and no pattern runs twice over a text
    found = own.select("doc_id", "text", *(
        F.when(F.contains(text, F.lit(k.hint)), F.regexp_extract_all(text, F.lit(k.pattern), F.lit(0))).otherwise(nothing).alias(f"v_{k.name}") for k in KINDS
    ))
    parts = found.select("doc_id", *(f"v_{k.name}" for k in KINDS), *(
        F.when(F.size(f"v_{k.name}") > 0, F.split(text, k.pattern, -1)).otherwise(nothing).alias(f"p_{k.name}") for k in KINDS
    ))
    return parts.select("doc_id", F.concat(*(_located(k) for k in KINDS)).alias("spans"))


def op7_pii(spark, sf_dir: str) -> DataFrame:
    found = find_pii(table(spark, sf_dir, "documents"))
    of = lambda k: F.filter("spans", lambda s: s["kind"] == k)
    said = lambda xs: F.array_join(F.transform(xs, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    return found.select(
        "doc_id",
        *(F.size(of(k)).cast("long").alias(f"n_{k}") for k in BASE),
        F.sha2(said(base).cast("binary"), 256).alias("base_sha256"),
        said(F.col("spans")).alias("spans"),
        F.array_join(F.transform("spans", lambda s: F.format_string("%.2f", s["score"])), ",").alias("scores"),
    )


def _sql_spans(kind: Kind, pattern: str, check: str) -> str:
    """DuckDB: spans of one kind, as a list of {s: 'kind:start:end', score}."""
    v, p = f"v_{kind.name}", f"p_{kind.name}"
    step = f"CASE WHEN regexp_matches(s.near, '\\b(?:{kind.helps})') THEN {CONTEXT_STEP} WHEN regexp_matches(s.near, '\\b(?:{kind.denies})') THEN -{CONTEXT_STEP} ELSE 0 END"
    return f"""list_filter(list_transform(list_filter(list_transform(range(1, len({v}) + 1),
          lambda i: {{'v': {v}[i], 'e': list_sum(list_transform({v}[1:i], lambda x: length(x))) + list_sum(list_transform({p}[1:i], lambda x: length(x))),
                     'near': lower(right({p}[i], {CONTEXT_BEFORE}) || ' ' || left({p}[i + 1], {CONTEXT_AFTER}))}}),
          lambda s: {check}), lambda s: {{'s': '{kind.name}:' || CAST(s.e - length(s.v) AS VARCHAR) || ':' || CAST(s.e AS VARCHAR), 'score': round(least(1.0, {kind.base_score} + {step}), 2)}}),
          lambda s: s.score >= {kind.least_score})"""


_DIGITS = "regexp_replace(s.v, '[^0-9]', '', 'g')"
_SQL = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true"),
    "ip": (r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", "len(list_filter(string_split(s.v, '.'), lambda x: CAST(x AS HUGEINT) > 255)) = 0"),
    "card": (
        r"[0-9](?:[\x20-]?[0-9])+",
        f"length({_DIGITS}) BETWEEN 13 AND 19 AND list_sum(list_transform(range(1, length({_DIGITS}) + 1), lambda i: CASE WHEN (length({_DIGITS}) - i) % 2 = 0 "
        f"THEN CAST(substr({_DIGITS}, i, 1) AS INT) ELSE (2 * CAST(substr({_DIGITS}, i, 1) AS INT)) % 10 + (2 * CAST(substr({_DIGITS}, i, 1) AS INT)) // 10 END)) % 10 = 0",
    ),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", f"length({_DIGITS}) BETWEEN 9 AND 15"),
    "iban": (
        r"\b[A-Z]{2}[0-9]{2}(?:(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?|[A-Z0-9]{11,30})\b",
        "length(replace(s.v, ' ', '')) BETWEEN 15 AND 34 AND list_reduce(list_transform(string_split(substr(replace(s.v, ' ', ''), 5) || left(s.v, 4), ''), "
        "lambda c: CASE WHEN ascii(c) < 58 THEN ascii(c) - 48 ELSE ascii(c) - 55 END), lambda a, c: (a * (CASE WHEN c > 9 THEN 100 ELSE 10 END) + c) % 97, 0) = 1",
    ),
    "ssn": (r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b", "left(s.v, 3) NOT IN ('000', '666') AND left(s.v, 1) <> '9' AND substr(s.v, 5, 2) <> '00' AND right(s.v, 4) <> '0000'"),
}

_KIND = {k.name: k for k in KINDS}
_LISTS = {n: " || ".join(k for k in _SQL if n == "all" or k in BASE) for n in ("base", "all")}
_SAID = {n: f"array_to_string(list_transform({x}, lambda s: s.s), ',')" for n, x in _LISTS.items()}
OP7_SQL = (
    "WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), m AS (SELECT doc_id, "
    + ", ".join(f"regexp_extract_all(t, '{p}') AS v_{k}, string_split_regex(t, '{p}') AS p_{k}" for k, (p, _) in _SQL.items())
    + " FROM d), s AS (SELECT doc_id, "
    + ", ".join(f"{_sql_spans(_KIND[k], p, c)} AS {k}" for k, (p, c) in _SQL.items())
    + " FROM m) SELECT doc_id, "
    + ", ".join(f"CAST(len({k}) AS BIGINT) AS n_{k}" for k in BASE)
    + f", sha256({_SAID['base']}) AS base_sha256, {_SAID['all']} AS spans, array_to_string(list_transform({_LISTS['all']}, lambda s: printf('%.2f', s.score)), ',') AS scores FROM s"
)
