"""Personal data: pattern spans, and terms that give protected values away, in DataFrame operations only.

Patterns find values such as e-mail addresses. The words of a value's texts are then judged by the
whole corpus: from how many texts hold the word, the value, and both together follows the share of
the value's information content that the word discloses (pointwise mutual information over
information content). Terms above a threshold are generalised, those above a higher one removed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foresight.llm.guarded import guarded
from foresight.llm.workspace import Workspace

KINDS = ["email", "ip", "card", "phone", "number", "term"]
NUMBER, TERM = KINDS.index("number"), KINDS.index("term")
#: Texts that must hold term and value together before the corpus is believed.
SUPPORT = 3
#: Shares of a value's information content above which a term is generalised or removed.
GENERALISE, REMOVE = 0.75, 0.9

# Fixed patterns of the base kinds. Possessive repeats and the look behind change no match; they keep
# long runs of letters or digits from being tried again at every place.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Numbers inside a match that failed as a whole, such as a phone and a card number side by side.
_INNER = (
    r"\+[0-9]{1,3}[\x20-]?(?:\([0-9]{2,4}\)[\x20-]?)?[0-9]{3}[\x20-][0-9]{4}(?![0-9])"
    r"|(?<![0-9])[0-9]{14,19}(?![0-9])"
)
_WORD = r"\p{L}+"
_OCTET = r"^0*(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})$"


def _matches(text: Column, hits: Column, pattern: str) -> Column:
    """Each match with the length of the gap before it."""
    zipped = F.arrays_zip(hits.alias("hit"), F.split(text, pattern, -1).alias("gap"))

    def one(z: Column) -> Column:
        return F.struct(z["hit"].alias("hit"), F.char_length(z["gap"]).alias("gap"))

    return F.when(F.size(hits) > 0, F.transform(F.slice(zipped, 1, F.size(hits)), one))


def _luhn(digits: Column) -> Column:
    turned = F.reverse(digits)

    def add(total: Column, place: Column) -> Column:
        digit = F.substring(turned, place, F.lit(1)).cast("int")
        double = F.when(digit > 4, digit * 2 - 9).otherwise(digit * 2)
        return total + F.when(place % 2 == 0, double).otherwise(digit)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _valid() -> Column:
    digits = F.regexp_replace("hit", "[^0-9]", "")
    n = F.length(digits)
    octets = F.forall(F.split("hit", r"\."), lambda p: p.rlike(_OCTET))
    return (
        F.when(F.col("kind") == "email", True)
        .when(F.col("kind") == "ip", octets)
        .when(F.col("kind") == "phone", (n >= 10) & (n <= 15))
        .otherwise(F.when((n >= 14) & (n <= 19), _luhn(digits)).otherwise(False))
    )


def _inner_numbers(hit: Column, base: Column) -> Column:
    """Places of numbers within a failed match: phones by their form, others by the card checksum."""
    parts = F.regexp_extract_all(hit, F.lit(_INNER), F.lit(0))
    zipped = F.slice(F.arrays_zip(parts.alias("w"), F.split(hit, _INNER, -1).alias("gap")), 1, F.size(parts))
    at = "struct<at: int, out: array<struct<start: bigint, end: bigint>>>"
    start = F.struct(F.lit(0).alias("at"), F.array().alias("out")).cast(at)

    def step(state: Column, z: Column) -> Column:
        first = state["at"] + F.length(z["gap"])
        end = first + F.length(z["w"])
        good = z["w"].startswith("+") | _luhn(F.regexp_replace(z["w"], "[^0-9]", ""))
        place = F.struct((base + first).alias("start"), (base + end).alias("end"))
        return F.struct(
            end.alias("at"), F.when(good, F.concat(state["out"], F.array(place))).otherwise(state["out"]).alias("out")
        )

    return F.aggregate(zipped, start, step, lambda s: s["out"])


def _word_places(texts: DataFrame) -> DataFrame:
    """(row, term, start, end): every word in lower case."""
    words = F.regexp_extract_all("text", F.lit(_WORD), F.lit(0))
    found = texts.filter(F.col("text").rlike(_WORD)).select("row", F.posexplode(_matches(F.col("text"), words, _WORD)))
    so_far = Window.partitionBy("row").orderBy("pos")
    end = F.sum(F.col("col.gap") + F.char_length("col.hit")).over(so_far).cast("bigint")
    return found.withColumn("end", end).select(
        "row", F.lower("col.hit").alias("term"), (F.col("end") - F.char_length("col.hit")).alias("start"), "end"
    )


def _numbered(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(
        F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")
    ).withColumn("row", F.monotonically_increasing_id())


def _base(numbered: DataFrame, space: Workspace, keep: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The rows without texts, the valid base spans, and numbers in failed matches."""
    hits = numbered.withColumns(
        {f"hits_{k}": F.regexp_extract_all("text", F.lit(p), F.lit(0)) for k, p in PATTERNS.items()}
    )
    found = space.put(
        hits.select(
            "row",
            *keep,
            *[_matches(F.col("text"), F.col(f"hits_{k}"), p).alias(k) for k, p in PATTERNS.items()],
        ),
        "found",
    )
    kinds = F.array(
        *[F.struct(F.lit(k).alias("kind"), F.lit(i).alias("order"), F.col(k).alias("m")) for i, k in enumerate(PATTERNS)]
    )
    single = (
        found.select("row", F.explode(kinds).alias("k"))
        .select("row", "k.kind", "k.order", F.posexplode("k.m").alias("place", "m"))
        .select("row", "kind", "order", "place", "m.*")
    )
    so_far = Window.partitionBy("row", "kind").orderBy("place")
    end = F.sum(F.col("gap") + F.char_length("hit")).over(so_far)
    spans = (
        single.withColumn("end", end.cast("bigint"))
        .withColumn("start", F.col("end") - F.char_length("hit"))
        .withColumn("valid", _valid())
        .withColumn("entity", F.xxhash64("kind", F.lower("hit")))
    )
    columns = ["row", "order", "start", "end", "entity"]
    failed = ~F.col("valid") & F.col("kind").isin("card", "phone")
    inner = F.when(failed, _inner_numbers(F.col("hit"), F.col("start")))
    judged = space.put(
        spans.withColumn("inner", inner).filter(F.col("valid") | (F.size("inner") > 0)).select(*columns, "valid", "inner"),
        "judged-spans",
    )
    base = judged.filter("valid").select(*columns)
    numbers = (
        judged.select("row", F.explode("inner").alias("n"))
        .select("row", "n.*")
        .distinct()
        .join(base.select("row", "start", "end"), ["row", "start", "end"], "left_anti")
    )
    return found.select("row", *keep), base, numbers


def disclosing_terms(
    texts: DataFrame, base: DataFrame, space: Workspace, support: int, generalise: float, remove: float
) -> DataFrame:
    """Spans of terms (row, start, end, action) that disclose too much of a value of their text.

    All counts are numbers of texts over the whole corpus; words within e-mail addresses, the only
    values with letters, do not count. Pairs are formed in texts of values and of terms that can
    reach the thresholds at all: with n_both <= n_value the wanted share of the information
    bounds n_term for each value. Every occurrence in a text that holds the value is marked.
    """
    held = space.put(base.select("row", "entity").distinct(), "held")
    n_texts = F.lit(float(max(2, texts.count())))
    content = F.log(n_texts / F.col("n_value"))
    of_values = space.put(
        held.groupBy("entity")
        .agg(F.count("*").alias("n_value"))
        .filter(F.col("n_value") >= support)
        .withColumn("most", n_texts * F.exp(-F.lit(float(generalise)) * content) * (1 + 1e-9)),
        "of-values",
    )
    able = space.put(held.join(of_values, "entity"), "able")
    plain = F.regexp_replace(F.lower("text"), PATTERNS["email"], " ")
    words = F.array_distinct(F.regexp_extract_all(plain, F.lit(_WORD), F.lit(0)))
    counted = texts.select(F.explode(words).alias("term")).groupBy("term").agg(F.count("*").alias("n_term"))
    most = of_values.agg(F.max("most")).first()[0] or 0.0
    of_terms = space.put(counted.filter((F.col("n_term") >= support) & (F.col("n_term") <= most)), "of-terms")
    rows = space.put(able.groupBy("row").agg(F.max("most").alias("most")), "able-rows")
    uses = texts.join(rows.select("row"), "row", "left_semi").select("row", F.explode(words).alias("term"))
    near = space.put(uses.join(of_terms, "term"), "near")
    pairs = (
        near.join(able, "row")
        .filter(F.col("n_term") <= F.col("most"))
        .groupBy("entity", "term", "n_term", "n_value")
        .agg(F.count("*").alias("n_both"))
        .filter(F.col("n_both") >= support)
    )
    mutual = F.log(F.col("n_both") * n_texts / (F.col("n_term") * F.col("n_value")))
    disclosed = F.when(content > 0, mutual / content).otherwise(0.0)
    judged = space.put(
        pairs.withColumn("disclosed", disclosed)
        .filter(F.col("disclosed") >= generalise)
        .select(
            "entity", "term", F.when(F.col("disclosed") >= remove, "remove").otherwise("generalise").alias("action")
        ),
        "judged",
    )
    in_rows = space.put(
        near.select("row", "term")
        .join(held, "row")
        .join(judged, ["entity", "term"])
        .groupBy("row", "term")
        .agg(F.max("action").alias("action")),
        "in-rows",
    )
    marked = texts.join(in_rows.select("row").distinct(), "row", "left_semi")
    return _word_places(marked).join(in_rows, ["row", "term"]).select("row", "start", "end", "action")


def _spans(numbered, space, keep, support, generalise, remove) -> tuple[DataFrame, DataFrame]:
    rows, base, numbers = _base(numbered, space, keep)
    terms = disclosing_terms(numbered.select("row", "text"), base, space, support, generalise, remove)
    flat = (
        base.select("row", "start", "order", "end", F.lit("replace").alias("action"))
        .union(numbers.select("row", "start", F.lit(NUMBER).alias("order"), "end", F.lit("replace")))
        .union(terms.select("row", "start", F.lit(TERM).alias("order"), "end", "action"))
    )
    before = Window.partitionBy("row").orderBy("start", "order", "end").rowsBetween(Window.unboundedPreceding, -1)
    covered = flat.withColumn("covered", F.coalesce(F.max("end").over(before), F.lit(0)))
    span = F.struct("start", "order", "end", "covered", "action")
    covered = covered.filter((F.col("order") != TERM) | (F.col("end") > F.col("covered")))  # words within values
    by_row = covered.groupBy("row").agg(F.array_sort(F.collect_list(span)).alias("spans"))
    return rows, by_row


def _named(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.transform(
        spans,
        lambda s: F.struct(
            F.get(names, s["order"]).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["action"].alias("action")
        ),
    )


def find(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    support: int = SUPPORT,
    generalise: float = GENERALISE,
    remove: float = REMOVE,
) -> DataFrame:
    """One row per input row: ``id_col`` and ``spans`` (kind, start, end, action) by start and kind.

    Places are code points, ends exclusive. Base kinds are always found; kind ``number`` marks phone
    and card numbers inside a run of digits that is too long to be one, kind ``term`` words of a
    value's texts that disclose ``generalise`` or more of it, in ``support`` texts or more. Null and
    empty texts give no spans, repeated rows are searched each on their own, an empty table gives an
    empty result, and other columns are ignored.

    Values found, words and counts are shuffled, and so may be texts that hold a value that others hold too.
    """
    space = Workspace(docs.sparkSession, "pii")
    numbered = space.put(_numbered(docs, id_col, text_col), "numbered")  # row numbers hold for every reader
    rows, by_row = _spans(numbered, space, ["id"], support, generalise, remove)
    none = F.expr("array()").cast(by_row.schema["spans"].dataType)
    return rows.join(by_row, "row", "left").select(
        F.col("id").alias(id_col), _named(F.coalesce("spans", none)).alias("spans")
    )


def sanitise(
    docs: DataFrame,
    text_col: str = "text",
    support: int = SUPPORT,
    generalise: float = GENERALISE,
    remove: float = REMOVE,
) -> DataFrame:
    """The input with cleaned texts: values become their kind in brackets, terms a mark or nothing.

    Texts without spans come back as they are, null ones as null. Where spans overlap, the first one's
    mark stands for all that they cover. Other columns pass through, whatever their names; repeated rows
    are cleaned alike, an empty table stays empty.
    """
    return guarded(docs, [text_col], lambda d: _cleaned(d, text_col, support, generalise, remove))


def _cleaned(docs: DataFrame, text_col: str, support: int, generalise: float, remove: float) -> DataFrame:
    space = Workspace(docs.sparkSession, "pii")
    stored = space.put(docs.withColumn("_row", F.monotonically_increasing_id()), "stored")
    numbered = stored.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), F.col("_row").alias("row"))
    _, by_row = _spans(numbered, space, [], support, generalise, remove)
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    text = F.col(text_col)

    def piece(s: Column) -> Column:
        kept = F.substring(text, (s["covered"] + 1).cast("int"), F.greatest(s["start"] - s["covered"], F.lit(0)).cast("int"))
        mark = F.when((s["start"] < s["covered"]) | (s["action"] == "remove"), "").otherwise(F.get(names, s["order"]))
        return F.concat(kept, mark)

    last = F.array_max(F.transform("_spans", lambda s: s["end"]))
    tail = F.substring(text, (last + 1).cast("int"), F.char_length(text))
    cleaned = F.when(F.col("_spans").isNull(), text).otherwise(
        F.concat(F.array_join(F.transform("_spans", piece), ""), tail)
    )
    joined = stored.join(by_row.toDF("_row", "_spans"), "_row", "left")
    return joined.select(*[cleaned.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns])


def spans_text(spans: Column) -> Column:
    """kind:start:end of every span, comma-joined."""
    return F.concat_ws(
        ",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"]))
    )
