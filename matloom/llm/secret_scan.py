"""Secret scan: fixed patterns and character Markov models, in Spark functions.

Base spans come from three patterns.  The method adds long runs of key-like
characters whose transitions fit a model of random strings better than a model
of ordinary identifiers: the log-likelihood ratio of two first-order Markov
chains over ASCII characters, summed over the run.  The models are trained on
labelled strings: words of at most ``LABELLED`` labelled good documents, and
``RANDOM`` strings of each of three forms drawn by a hash function.

Positions are code points.  A pattern's matches are located by splitting the
text at them: the pieces before a match and the matches themselves add up to
its start.

Defined results: a null text is empty and has no spans; repeated rows are
scanned one by one; without labelled words there is no identifier model
and no span is added; an empty table gives an empty result; other columns are
ignored (the scan) or kept as they are (masking).
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from matloom.llm.common import documents, let, words_of
from matloom.llm.registry import query
from matloom.llm.tables import literal_table

#: The base patterns, in the order in which their kinds sort.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: A run as long as its alphabet reaches, of at least the length asked for.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
RUN = r"[A-Za-z0-9+/_=-]{20,}"
MIN_VALUE = 6
KINDS = ("assign", "access", "hex", "markov")
#: Most labelled documents that train the models.
LABELLED = 5_000
#: Numbers from which random strings are drawn by a hash function.
RANDOM = 4_096
ALPHABET = 128
SMOOTHING = 0.5
#: Log-likelihood ratio, in all and per transition, of a span that is added.
MIN_RATIO, MIN_MEAN_RATIO = 12.0, 0.6
MASK = "[SECRET]"

SPAN = "array<struct<start:int,rank:int,end:int>>"
#: Elements gathered in one array before they join the others.
CHUNK = 256
#: Code points of a text or run that are walked from a known place.
PIECE = 1024


# -- positions ----------------------------------------------------------------


def running(rows: Column, zero: Column, step: Callable[[Column, Column], Column], told: Callable[[Column, Column], Column], kind: str) -> Column:
    """``told(state before x, x)`` of every element x, with ``step`` as the next state.

    Results are gathered in chunks, so that no array is copied once per element.
    """
    chunks = F.transform(F.sequence(F.lit(1), F.size(rows), F.lit(CHUNK)), lambda k: F.slice(rows, k, CHUNK))

    def add(a: Column, x: Column) -> Column:
        return F.struct(step(a["at"], x).alias("at"), F.concat(a["out"], F.array(told(a["at"], x))).alias("out"))

    def whole(a: Column, chunk: Column) -> Column:
        begin = F.struct(a["at"].alias("at"), F.array().cast(f"array<{kind}>").alias("out"))
        part = F.aggregate(chunk, begin, add)
        return let(part, lambda r: F.struct(r["at"].alias("at"), F.concat(a["out"], F.array(r["out"])).alias("out")))

    empty = F.array().cast(f"array<{kind}>")
    start = F.struct(zero.alias("at"), F.array().cast(f"array<array<{kind}>>").alias("out"))
    return F.when(F.size(rows) == 0, empty).otherwise(F.aggregate(chunks, start, whole, lambda a: F.flatten(a["out"])))


def located(text: Column, pattern: str, rank: int, keep: Callable[[Column, Column], Column] | None = None, group: int = 0) -> Column:
    """Spans of all matches; ``keep`` sees a match and its ``group``."""

    def place(found: Column) -> Column:
        gaps = F.split(text, pattern, -1)
        parts = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found

        def walk(gap: Column) -> Column:
            rows = F.arrays_zip(found.alias("m"), F.slice(gap, 1, F.size(found)).alias("g"), parts.alias("p"))
            steps = F.transform(
                rows,
                lambda r: F.struct(
                    F.length(r["g"]).alias("gap"),
                    F.length(r["m"]).alias("len"),
                    (keep(r["m"], r["p"]) if keep else F.lit(True)).alias("ok"),
                ),
            )
            span = lambda at, x: F.struct((at + x["gap"]).alias("start"), (at + x["gap"] + x["len"]).alias("end"), x["ok"].alias("ok"))
            after = lambda at, x: at + x["gap"] + x["len"]
            placed = let(steps, lambda rows: running(rows, F.lit(0), after, span, "struct<start:int,end:int,ok:boolean>"))
            kept = F.filter(placed, lambda s: s["ok"])
            return F.transform(kept, lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end")))

        return F.when(F.size(found) == 0, F.array().cast(SPAN)).otherwise(let(gaps, walk))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), place)


def apart(base: Column, more: Column) -> Column:
    """All spans of ``base`` and those of ``more`` that overlap none of these, by position.

    ``more`` has the larger rank.  A span is free if no base span before it reaches
    into it, and the next one begins behind it: one pass from either end.
    """
    own = lambda s: s["rank"] < F.lit(KINDS.index("markov"))
    kind = "struct<start:int,rank:int,end:int,free:boolean>"
    with_free = lambda s, free: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"), free.alias("free"))

    def forth(spans: Column) -> Column:
        reach = lambda at, s: F.when(own(s), F.greatest(at, s["end"])).otherwise(at)
        return running(spans, F.lit(0), reach, lambda at, s: with_free(s, own(s) | (at <= s["start"])), kind)

    def back(spans: Column) -> Column:
        nearest = lambda at, s: F.when(own(s), s["start"]).otherwise(at)
        return running(spans, F.lit(2**31 - 1), nearest, lambda at, s: with_free(s, own(s) | (s["free"] & (at >= s["end"]))), kind)

    def merged(spans: Column) -> Column:
        free = F.filter(F.reverse(let(F.reverse(forth(spans)), back)), lambda s: s["free"])
        return F.transform(free, lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end")))

    both = let(F.sort_array(F.concat(base, more)), merged)
    return F.when(F.size(more) == 0, base).when(F.size(base) == 0, more).otherwise(both)


def base_spans(text: Column) -> Column:
    none = F.array().cast(SPAN)
    assign = located(text, ASSIGN, 0, lambda m, value: F.length(value) >= MIN_VALUE, group=2)
    return F.sort_array(
        F.concat(
            # An assignment has one of its signs, an access key its prefix.
            F.when(F.contains(text, F.lit("=")) | F.contains(text, F.lit(":")), assign).otherwise(none),
            F.when(F.contains(text, F.lit("AKIA")), located(text, ACCESS, 1)).otherwise(none),
            located(text, HEX, 2),
        )
    )


# -- models -------------------------------------------------------------------


def labelled_strings(docs: DataFrame, labels: DataFrame, most: int = LABELLED) -> DataFrame:
    """``(string, random)``: identifiers of good documents, and random strings."""
    good = labels.where("quality = 1 AND toxic = 0 AND doc_id IS NOT NULL").select(F.col("doc_id").alias("_good")).distinct()
    sample = good.orderBy(F.xxhash64("_good"), "_good").limit(most)
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), F.col("doc_id") == F.col("_good"), "left_semi")
    plain = rows.select(F.explode(words_of(F.col("text"))).alias("string"), F.lit(0).alias("random")).where(r"string RLIKE '^[A-Za-z_-]+$'")
    digest = F.sha2(F.concat(F.lit("sample:"), F.col("id").cast("string")), 512)
    forms = F.array(digest, F.base64(F.unhex(digest)), F.upper(F.conv(F.substring(digest, 1, 15), 16, 36)))
    drawn = docs.sparkSession.range(RANDOM).select(F.explode(forms).alias("string"), F.lit(1).alias("random"))
    return plain.unionByName(drawn)


def learn_ratio(strings: DataFrame, smoothing: float = SMOOTHING) -> list[float]:
    """Log ratio of the two chains for every pair of ASCII characters."""
    pair = lambda s, i: F.ascii(F.substring(s, i, 1)) * ALPHABET + F.ascii(F.substring(s, i + 1, 1))
    long = strings.where((F.length("string") > 1) & ~F.col("string").rlike(r"[^\x00-\x7F]"))
    pairs = F.transform(F.sequence(F.lit(1), F.length("string") - 1), lambda i: pair(F.col("string"), i))
    counts = long.select("random", F.explode(pairs).alias("pair")).groupBy("random", "pair").agg(F.count(F.lit(1)).alias("n"))
    seen = [[smoothing] * ALPHABET**2, [smoothing] * ALPHABET**2]
    for r in counts.collect():
        seen[r["random"]][r["pair"]] += r["n"]
    if sum(seen[0]) == smoothing * ALPHABET**2:
        return [0.0] * ALPHABET**2
    logs = []
    for n in seen:
        rows = [sum(n[a * ALPHABET : (a + 1) * ALPHABET]) for a in range(ALPHABET)]
        logs.append([math.log(x / rows[k // ALPHABET]) for k, x in enumerate(n)])
    return [b - a for a, b in zip(*logs)]


def pieces(string: Column) -> Column:
    """A string in pieces of ``PIECE`` code points."""
    return F.regexp_extract_all(string, F.lit("(?s).{1,%d}" % PIECE), F.lit(0))


def ratio_of(string: Column, table: Column) -> Column:
    """Sum of the table over all transitions of an ASCII string, read once."""
    zero = F.struct(F.lit(-1).alias("last"), F.lit(0.0).alias("sum"))

    def add(a: Column, code: Column) -> Column:
        more = F.when(a["last"] < 0, F.lit(0.0)).otherwise(F.get(table, a["last"] * ALPHABET + code))
        return F.struct(code.alias("last"), (a["sum"] + more).alias("sum"))

    codes = lambda piece: F.transform(F.split(piece, ""), lambda c: F.ascii(c))
    return F.aggregate(pieces(string), zero, lambda a, piece: F.aggregate(codes(piece), a, add), lambda a: a["sum"])


def markov_spans(text: Column, ratio: list[float]) -> Column:
    table = literal_table(ratio)
    least = lambda run: F.greatest(F.lit(MIN_RATIO), MIN_MEAN_RATIO * (F.length(run) - 1))
    return located(text, RUN, 3, lambda run, _: let(run, lambda r: ratio_of(r, table) >= least(r)))


def scan(docs: DataFrame, ratio: list[float], keep: list[str]) -> DataFrame:
    """Columns ``keep`` with ``_base`` and ``_all``, arrays of spans by position."""
    text = F.coalesce(F.col("text"), F.lit(""))
    found = docs.select(*keep, text.alias("_text")).withColumn("_base", base_spans(F.col("_text")))
    found = found.withColumn("_run", markov_spans(F.col("_text"), ratio))
    return found.withColumn("_all", apart(F.col("_base"), F.col("_run"))).drop("_run")


def told(spans: Column) -> Column:
    """``kind:start:end`` of sorted spans, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["rank"]), s["start"], s["end"])), ",")


def find_secrets(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Counts per base kind, a digest of the base spans, and all spans."""
    ratio = learn_ratio(labelled_strings(docs, labels))
    count = lambda k: F.size(F.filter("_base", lambda s: s["rank"] == k)).cast("long")
    return scan(docs, ratio, ["doc_id"]).select(
        "doc_id",
        *[count(k).alias(f"n_{KINDS[k]}") for k in range(3)],
        F.sha2(told(F.col("_base")), 256).alias("base_sha256"),
        told(F.col("_all")).alias("spans"),
    )


def masked_text(text: Column, spans: Column, mask: str) -> Column:
    """The text with each stretch of overlapping spans replaced by one mask."""

    def cut(parts: Column) -> Column:
        def between(a: Column, b: Column) -> Column:
            """Code points from ``a`` up to ``b``, of the pieces that hold them."""
            first, last = F.floor(a / PIECE).cast("int"), F.floor((b - 1) / PIECE).cast("int")
            inside = lambda k: F.substring(F.get(parts, k), F.greatest(a - k * PIECE, F.lit(0)) + 1, F.least(b - k * PIECE, F.lit(PIECE)) - F.greatest(a - k * PIECE, F.lit(0)))
            return F.when(b > a, F.array_join(F.transform(F.sequence(first, last), inside), "")).otherwise(F.lit(""))

        reach = lambda at, s: F.greatest(at, s["end"])
        held = running(spans, F.lit(0), reach, lambda at, s: F.struct(at.alias("at"), s["start"].alias("start")), "struct<at:int,start:int>")
        fresh = F.filter(held, lambda s: s["start"] >= s["at"])
        heads = F.transform(fresh, lambda s: F.concat(between(s["at"], s["start"]), F.lit(mask)))
        end = F.array_max(F.transform(spans, lambda s: s["end"]))
        return F.array_join(F.concat(heads, F.array(between(end, F.length(text)))), "")

    return let(pieces(text), cut)


def mask_secrets(docs: DataFrame, labels: DataFrame, mask: str = MASK) -> DataFrame:
    """The same rows and columns with every span replaced in ``text``."""
    ratio = learn_ratio(labelled_strings(docs, labels))
    # The row travels as one value, so no column of the caller can clash.
    found = scan(docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs["text"]), ratio, ["row"])
    dirty = F.size("_all") > 0
    found = found.select("row", dirty.alias("dirty"), F.when(dirty, masked_text(F.col("_text"), F.col("_all"), mask)).alias("clean"))
    new = {"text": F.col("clean"), "n_chars": F.length("clean").cast("long")}
    old = {c: F.col("row").getField(c) for c in docs.columns}
    return found.select(*[(F.when(F.col("dirty"), new[c]).otherwise(old[c]) if c in new else old[c]).alias(c) for c in docs.columns])


@query("op7_secrets")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return find_secrets(documents(spark, sf_dir), labels)
