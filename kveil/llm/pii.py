"""Personal data: expressions propose spans, checksums confirm them, context words adjust the score.

Spark SQL only. No kind of span crosses a line break, so each line with a digit or an ``@`` is
searched by itself and all other text is left alone. The patterns are possessive or start only
where a match can start, which finds the same leftmost matches as the plain forms in the comments but
needs neither backtracking nor recursion on very long runs.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kveil.llm.common import chunks_of, col, let, part_of, running_totals, table


@dataclass(frozen=True)
class Kind:
    """A kind of personal data: where it may be, which matches count, and how sure that makes us."""

    name: str
    hint: str  # a line without it is not searched
    pattern: str
    valid: Callable[[Column], Column]
    score: float
    context: str  # words that raise the score when they stand just before the span


def digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(match: Column) -> Column:
    """13 to 19 digits whose Luhn sum is a multiple of ten."""
    number = digits(match)

    def worth(c: Column, i: Column) -> Column:
        d = F.ascii(c) - 48
        return F.when(i % 2 == 0, d).when(d > 4, d * 2 - 9).otherwise(d * 2)

    total = F.aggregate(F.transform(F.split(F.reverse(number), ""), worth), F.lit(0), lambda a, x: a + x)
    return F.when(F.length(number).between(13, 19), total % 10 == 0).otherwise(False)


def mod97(match: Column) -> Column:
    """An international account number: country and check digits to the end, letters as numbers, rest 1."""
    plain = F.replace(match, F.lit(" "), F.lit(""))
    turned = F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.substring(plain, 1, 4))

    def step(rest: Column, c: Column) -> Column:
        code = F.ascii(c)
        return F.when(code < 58, (rest * 10 + code - 48) % 97).otherwise((rest * 100 + code - 55) % 97)

    rest = F.aggregate(F.split(turned, ""), F.lit(0), step)
    return F.when(F.length(plain).between(15, 34), rest == 1).otherwise(False)


def small_parts(match: Column) -> Column:
    part = r"^0*(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})$"
    return F.forall(F.split(match, r"\."), lambda p: p.rlike(part))


def phone_length(match: Column) -> Column:
    return F.length(digits(match)).between(9, 15)


def always(match: Column) -> Column:
    return F.lit(True)


LOCAL = "A-Za-z0-9._%+-"
BASE = (
    # [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
    Kind(
        "email",
        "@",
        rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
        always,
        0.9,
        "mail|e-mail|email|contact|contacto|courriel|kontakt",
    ),
    # [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
    Kind(
        "ip",
        ".",
        r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
        small_parts,
        0.6,
        "ip|host|server|address|adresse|addr",
    ),
    # [0-9]([\x20-]?[0-9])+
    Kind("card", "", r"[0-9](?:[\x20-]?+[0-9])++", luhn, 0.8, "card|visa|credit|karte|carte|tarjeta"),
    # \+[0-9][\x20().0-9-]+[0-9]
    Kind("phone", "+", r"\+[0-9][\x20().0-9-]+[0-9]", phone_length, 0.7, "phone|tel|call|fax|mobile|telefon|móvil"),
)
ADDED = (
    Kind(
        "iban",
        "",
        r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])",
        mod97,
        0.9,
        "iban|account|konto|compte|cuenta",
    ),
    Kind(
        "ssn",
        "-",
        r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])",
        always,
        0.4,
        "ssn|social|security",
    ),
    Kind(
        "local_phone",
        "",
        r"(?<![0-9+.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9-])",
        always,
        0.4,
        "phone|tel|call|fax|mobile|telefon|móvil|téléphone",
    ),
)
KINDS = BASE + ADDED
AGAINST = "order|invoice|version|isbn|part|serial|bestellung|facture|pedido"
NEAR = 40  # characters before a span that count as its context
RAISE, LOWER, LEAST = 0.35, 0.3, 0.5


def candidates(line: Column, chunks: Column, number: int, kind: Kind) -> Column:
    """Valid matches of a kind in a line: [(kind, start, end, score)], places from 0 in code points."""
    pattern = F.lit(kind.pattern)

    def located(found: Column) -> Column:
        between = F.split(line, pattern, -1)
        lengths = F.zip_with(F.slice(between, F.lit(1), F.size(found)), found, lambda b, m: F.length(b) + F.length(m))

        def spans(widths: Column) -> Column:
            def span_of(starts: Column):
                def span(m: Column, i: Column) -> Column:
                    end = F.element_at(starts, i + 1) + F.element_at(widths, i + 1)
                    return F.struct(
                        F.lit(number).alias("kind"),
                        (end - F.length(m)).cast("int").alias("start"),
                        end.cast("int").alias("end"),
                        m.alias("match"),
                    )

                return F.transform(found, span)

            return let(running_totals(widths), span_of)

        return let(lengths, spans)

    def kept(spans: Column) -> Column:
        return F.transform(
            F.filter(spans, lambda s: kind.valid(s["match"])),
            lambda s: F.struct(s["kind"], s["start"], s["end"], score(chunks, s["start"], kind).alias("score")),
        )

    found = F.regexp_extract_all(line, pattern, F.lit(0))
    empty = F.array().cast("array<struct<kind:int,start:int,end:int,score:double>>")
    spans = let(found, lambda m: F.when(F.size(m) > 0, kept(located(m))).otherwise(empty))
    return F.when(F.contains(line, F.lit(kind.hint)), spans).otherwise(empty) if kind.hint else spans


def score(chunks: Column, start: Column, kind: Kind) -> Column:
    """The kind's own score, adjusted by the words just before the span."""
    before = F.lower(part_of(chunks, F.greatest(start - NEAR, F.lit(0)), start))

    def says(words: str) -> Column:
        return before.rlike(rf"(?<![\p{{L}}])(?:{words})(?![\p{{L}}])")

    return (
        F.lit(kind.score)
        + F.when(says(kind.context), RAISE).otherwise(0.0)
        - F.when(says(AGAINST), LOWER).otherwise(0.0)
    )


def how_many(items: Column, test) -> Column:
    """How many of the first items meet a test that all after the first failing one fail too: halving steps."""
    steps = F.sequence(F.lit(1), F.length(F.bin(F.size(items).cast("long"))))
    start = F.struct(F.lit(0).alias("low"), F.size(items).alias("high"))

    def step(acc: Column, _: Column) -> Column:
        low, high, middle = acc["low"], acc["high"], F.shiftright(acc["low"] + acc["high"], 1)
        meets = (low < high) & test(F.get(items, middle))
        return F.struct(
            F.when(meets, middle + 1).otherwise(low).alias("low"),
            F.when(meets | (low >= high), high).otherwise(middle).alias("high"),
        )

    return F.aggregate(steps, start, step, lambda acc: acc["low"])


def overlaps(spans: Column, s: Column) -> Column:
    """Whether a span overlaps one of a kind's spans, which are in order and apart."""
    first = F.get(spans, how_many(spans, lambda b: b["end"] <= s["start"]))
    return F.coalesce(first["start"] < s["end"], F.lit(False))


def line_lists(line: Column, chunks: Column) -> Column:
    """Spans of a line by kind: the base kinds' valid matches, and added ones that score and overlap none of them."""
    base = F.array(*(candidates(line, chunks, i, k) for i, k in enumerate(BASE)))
    more = F.array(*(candidates(line, chunks, i + len(BASE), k) for i, k in enumerate(ADDED)))

    def joined(found: Column) -> Column:
        def new(s: Column) -> Column:
            return (s["score"] >= LEAST) & ~F.exists(found, lambda spans: overlaps(spans, s))

        return F.concat(found, F.transform(more, lambda spans: F.filter(spans, new)))

    return let(base, joined)


def searched(line: Column) -> Column:
    return line.rlike("[0-9@]")


def text_spans(text: Column) -> Column:
    """All spans of a text: [(kind, start, end, score)] by kind, then start."""

    def from_lines(lines: Column) -> Column:
        def placed(starts: Column) -> Column:
            worth = F.filter(
                F.transform(lines, lambda x, i: F.when(searched(x), F.struct(x.alias("line"), i.alias("i")))),
                lambda x: x.isNotNull(),
            )

            def moved(c: Column) -> Column:
                at = F.element_at(starts, c["i"] + 1).cast("int")
                return F.transform(
                    let(chunks_of(c["line"]), lambda x: F.flatten(line_lists(c["line"], x))),
                    lambda s: F.struct(
                        s["kind"].alias("kind"),
                        (s["start"] + at).alias("start"),
                        (s["end"] + at).alias("end"),
                        s["score"].alias("score"),
                    ),
                )

            return F.sort_array(F.flatten(F.transform(worth, moved)))

        return let(running_totals(F.transform(lines, lambda x: F.length(x) + 1)), placed)

    return let(F.split(F.coalesce(text, F.lit("")), "\n"), from_lines)


def find_personal_data(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with ``personal``, an array of (kind, start, end, score) per row: ends exclusive, code points.

    A projection, so null and repeated ids and repeated rows are searched row by row. A null text
    counts as empty and has no spans. Kinds are numbered as in KINDS. A column named ``personal`` is
    replaced, all others pass unchanged. An empty table gives an empty table.
    """
    return df.withColumn("personal", text_spans(col(text_col)))


def masked_line(line: Column) -> Column:
    """The line with each span, or run of overlapping spans, replaced by the kind's name in brackets."""
    names = F.array(*(F.lit(f"<{k.name.upper()}>") for k in KINDS))

    def place(s: Column) -> Column:
        return F.struct(s["start"], s["end"], s["kind"])

    def masked(chunks: Column) -> Column:
        def told(lists: Column) -> Column:
            by_place = F.array_sort(F.transform(F.flatten(lists), place))

            def reached(s: Column) -> Column:
                """Where the spans before this one end."""
                before = F.transform(lists, lambda k: F.get(k, how_many(k, lambda b: place(b) < s) - 1)["end"])
                return F.coalesce(F.array_max(before), F.lit(0))

            def piece(s: Column) -> Column:
                name = F.element_at(names, s["kind"] + 1)
                return let(reached(s), lambda at: F.when(s["start"] >= at, F.concat(part_of(chunks, at, s["start"]), name)))

            last = F.coalesce(F.array_max(F.transform(F.flatten(lists), lambda s: s["end"])), F.lit(0))
            whole = F.concat(F.array_join(F.transform(by_place, piece), ""), part_of(chunks, last, F.length(line)))
            return F.when(F.size(F.flatten(lists)) > 0, whole).otherwise(line)

        return let(line_lists(line, chunks), told)

    return let(chunks_of(line), masked)


def mask_personal_data(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with the spans of each text masked; null stays null, other columns pass unchanged."""
    lines = F.split(col(text_col), "\n")
    masked = F.transform(lines, lambda x: F.when(searched(x), masked_line(x)).otherwise(x))
    return df.withColumn(text_col, F.array_join(masked, "\n"))


def mask_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: every document, its personal data masked and ``n_chars`` counted anew."""
    masked = mask_personal_data(docs)
    if "n_chars" not in docs.columns:
        return masked
    kind = docs.schema["n_chars"].dataType
    same = F.length("text").cast(kind)
    return masked.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(same))


def spelled(spans: Column) -> Column:
    """``kind:start:end``, comma-joined."""
    names = F.array(*(F.lit(k.name) for k in KINDS))
    one = F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"]))
    return F.array_join(one, ",")


def op3_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_personal_data(docs)
    spans = F.col("personal")

    def count(i: int) -> Column:
        return F.size(F.filter(spans, lambda s: s["kind"] == i)).cast("long")

    base = F.filter(spans, lambda s: s["kind"] < len(BASE))
    return found.select(
        "doc_id",
        *(count(i).alias(f"n_{k.name}") for i, k in enumerate(BASE)),
        F.sha2(spelled(base), 256).alias("base_sha256"),
        spelled(spans).alias("spans"),
    )
