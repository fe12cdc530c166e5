"""Operator 10: personal data.

Regular expressions propose spans, checksums (Luhn, mod 97) and digit counts confirm them, words near a
span adjust its score. Everything is a DataFrame expression over the whole text of a row.

Offsets come from marking: every match is wrapped in a character that the text can't hold any more, the
text is split there, and the lengths of the parts add up to the offsets. Possessive quantifiers and the
condition that a match starts where a run starts (or where the last match ended) keep the patterns linear.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, let

MARK = "￿"
STAND_IN = "�"


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    needs: str  # a cheap test that any text with a match passes
    context: tuple[str, ...]
    base: bool = True


KINDS = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", ("mail", "email", "contact", "correo", "courriel")),
    Kind("ip", r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]\.[0-9]", ("ip", "host", "server", "address")),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", r"[0-9]", ("card", "visa", "credit", "karte", "tarjeta", "carte")),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]", ("phone", "tel", "call", "telefon", "téléphone", "teléfono")),
    Kind("iban", r"(?:\G|(?<![A-Za-z0-9]))[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}+(?:\x20?[A-Z0-9]{1,3})?+(?![A-Za-z0-9])", r"[A-Z]{2}[0-9]{2}", ("iban", "bank", "konto", "account"), base=False),
)


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn_ok(digits: Column) -> Column:
    """The Luhn checksum of a string of digits."""

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, -1 * i, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 1, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def mod97_ok(account: Column) -> Column:
    """The mod-97 checksum of an international account number."""
    bare = F.replace(account, F.lit(" "))
    moved = F.concat(F.substring(bare, F.lit(5), F.length(bare)), F.substring(bare, 1, 4))

    def step(rest: Column, c: Column) -> Column:
        v = F.ascii(c)
        return F.when(v < 58, (rest * 10 + v - 48) % 97).otherwise((rest * 100 + v - 55) % 97)

    return F.aggregate(F.split(moved, ""), F.lit(0), lambda r, c: F.when(c == "", r).otherwise(step(r, c))) == 1


def confirmed(kind: str, found: Column) -> Column:
    d = _digits(found)
    if kind == "ip":
        return F.forall(F.split(found, r"\."), lambda p: let(F.regexp_replace(p, "^0+", ""), lambda v: (F.length(v) < 3) | ((F.length(v) == 3) & (v <= "255"))))
    if kind == "card":
        return let(d, lambda v: F.when(F.length(v).between(16, 19), luhn_ok(v)).otherwise(F.lit(False)))
    if kind == "phone":
        return F.length(d).between(8, 15)
    if kind == "iban":
        return F.length(F.replace(found, F.lit(" "))).between(15, 34) & mod97_ok(found)
    return F.lit(True)


def spans(text: Column, kind: Kind, near: int = 40) -> Column:
    """The confirmed spans of a kind: array of (kind, start, end, score), code points, end exclusive.

    The score is 0.5 for a pattern alone, 0.75 with a checksum or digit count behind it, and 0.25 more where
    a context word stands within near characters before the span.
    """
    empty = F.array().cast("array<struct<kind:string,start:long,end:long,score:double>>")
    trust = 0.5 if kind.name == "email" else 0.75
    context = "(?i)(?:^|[^a-z])(?:" + "|".join(kind.context) + ")(?:[^a-z]|$)"

    def step(acc: Column, part: Column) -> Column:
        end = acc["at"] + F.length(part)
        told = F.when(F.right(acc["before"], F.lit(near)).rlike(context), "1").otherwise("0")
        span = F.concat_ws(" ", acc["at"].cast("string"), end.cast("string"), told, F.lit(";"))
        out = F.when(acc["inside"] & confirmed(kind.name, part), F.concat(acc["out"], span)).otherwise(acc["out"])
        return F.struct(end.alias("at"), out.alias("out"), part.alias("before"), (~acc["inside"]).alias("inside"))

    def block(parts: Column) -> Column:
        """The length of some parts, of which the first is no match, and the confirmed spans in them as text."""
        start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"), F.lit("").alias("before"), F.lit(False).alias("inside"))
        return F.aggregate(parts, start, step, lambda acc: F.struct(acc["at"].alias("at"), acc["out"].alias("out")))

    def placed(blocks: Column) -> Column:
        before = F.transform(blocks, lambda _, k: F.aggregate(F.slice(blocks, F.lit(1), k), F.lit(0).cast("long"), lambda n, b: n + b["at"]))
        return F.flatten(F.zip_with(blocks, before, lambda b, n: F.transform(F.array_remove(F.split(b["out"], ";"), ""), lambda x: let(F.split(x, " "), lambda v: span(v, n)))))

    def span(v: Column, n: Column) -> Column:
        score = F.lit(trust) + F.when(v[2] == "1", 0.25).otherwise(0.0)
        return F.struct(F.lit(kind.name).alias("kind"), (v[0].cast("long") + n).alias("start"), (v[1].cast("long") + n).alias("end"), score.alias("score"))

    def found(parts: Column) -> Column:
        # a fold copies its state at each step, so many parts are folded in blocks: an even number of parts each, a thousand blocks at most
        size = F.greatest(F.lit(512), (F.ceil(F.size(parts) / 2000) * 2).cast("int"))
        cut = F.transform(F.sequence(F.lit(0), ((F.size(parts) - 1) / size).cast("int")), lambda k: block(F.slice(parts, k * size + 1, size)))
        return F.when(F.size(parts) <= 512, placed(F.array(block(parts)))).otherwise(let(cut, placed))

    marked = F.split(F.regexp_replace(text, f"({kind.pattern})", f"{MARK}$1{MARK}"), MARK)
    return F.when(text.rlike(kind.needs) if kind.needs != "@" else text.contains("@"), let(marked, found)).otherwise(empty)


def find_pii(docs: DataFrame, text: str = "text", kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """docs plus pii, the spans of all kinds in the order of kinds, then by start.

    A null or empty text has none, and an empty table gives no rows. Rows are looked at one by one, so that repeated
    rows have the same spans; long texts are looked at whole. A column of docs named pii is replaced. Matches of one
    kind don't overlap; those of different kinds may.
    """
    own = docs.drop(*[c for c in docs.columns if c.lower() == "pii"])
    clean = fresh(own, "_pii_text")
    marked = own.withColumn(clean, F.translate(F.coalesce(F.col(text), F.lit("")), MARK, STAND_IN))
    return marked.withColumn("pii", F.concat(*[spans(F.col(clean), k) for k in kinds])).drop(clean)


def redact(docs: DataFrame, text: str = "text", least: float = 0.0) -> DataFrame:
    """The result of find_pii with each span of at least that score replaced by its kind in brackets.

    Where spans of different kinds overlap, the one that starts first (then the longer one) is shown.
    """
    ordered = F.array_sort(F.transform(F.filter("pii", lambda s: s["score"] >= least), lambda s: F.struct(s["start"].alias("a"), (-s["end"]).alias("z"), s["kind"].alias("k"))))
    begin = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))
    t = F.coalesce(F.col(text), F.lit(""))
    piece = lambda a, b: F.substring(t, (a + 1).cast("int"), (b - a).cast("int"))
    return docs.withColumn(
        "redacted",
        F.aggregate(
            ordered,
            begin,
            lambda acc, s: F.when(s["a"] < acc["at"], acc).otherwise(
                F.struct((-s["z"]).alias("at"), F.concat(acc["out"], piece(acc["at"], s["a"]), F.lit("["), s["k"], F.lit("]")).alias("out"))
            ),
            lambda acc: F.concat(acc["out"], piece(acc["at"], F.length(t).cast("long"))),
        ),
    )


def pii_digest(found: DataFrame, kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """doc_id, a count per base kind, the hash of the base spans and all spans as text."""
    line = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    base = [k.name for k in kinds if k.base]
    count = lambda k: F.size(F.filter("pii", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select(
        "doc_id",
        *[count(k) for k in base],
        F.sha2(F.array_join(F.transform(F.filter("pii", lambda s: s["kind"].isin(base)), line), ","), 256).alias("base_sha256"),
        F.array_join(F.transform("pii", line), ",").alias("spans"),
        F.array_max(F.transform("pii", lambda s: s["score"])).alias("top_score"),
    )
