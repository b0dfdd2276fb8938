"""Quality rules with cross-document line frequency, in Spark's own functions.

Base rules count words, symbols, repeated lines and repeated three-word windows of a document; a document
of under ``MIN_WORDS`` words, or with over half its words in repeated windows, fails. For the others, lines are
normalised (case, blanks, digits) and hashed, distinct documents are counted per host and line, and lines in more
documents of the host than its limit are removed; a document that keeps less than ``MIN_LEFT`` of its
words is depleted and rejected.

Documents of a host with the same text are copies of one another and count once, so that copying a document does not
turn its own lines into boilerplate; copies are another operator's task.
The limit of a host is ``MIN_DOCS`` documents or the share ``MAX_SHARE`` of its documents, whichever is more.

Cases: null text has no words and fails the base rules. A null host is a host of its own. Repeated rows give repeated
result rows. Texts of any length are processed whole. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.stage import broadcast_if_small, checkpointed
from .native import BLANK_RUN, BLANKS, let, words

MIN_WORDS = 50
MIN_DOCS = 20
MAX_SHARE = 0.02
MIN_LEFT = 0.3
#: Rows of frequent lines, or of rejected documents, that may be broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 200_000
_AT = 24


def repeated_words(ws: Column) -> Column:
    """Words inside three-word windows that are found twice or more; linear but for a sort.

    A window is a long: 40 bits of its hash above 24 bits of its place. After sorting, equal windows are
    neighbours. Neighbours with equal hashes are compared by their words; if any differ, or places need more
    bits, the windows themselves are sorted instead.
    """
    places = F.sequence(F.lit(0), F.size(ws) - 3)

    def window(i: Column) -> list[Column]:
        return [F.get(ws, i), F.get(ws, i + 1), F.get(ws, i + 2)]

    def covered(at: Column) -> Column:
        start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("e"))
        step = lambda a, p: F.struct((a["n"] + p + 3 - F.greatest(p, a["e"])).alias("n"), (p + 3).alias("e"))
        return F.aggregate(F.sort_array(at), start, step)["n"]

    def place(x: Column) -> Column:
        return x.bitwiseAND(F.lit((1 << _AT) - 1))

    def alike(x: Column, y: Column) -> Column:
        return F.coalesce(F.shiftright(x, _AT) == F.shiftright(y, _AT), F.lit(False))

    def same(x: Column, y: Column) -> Column:
        a, b = window(place(x).cast("int")), window(place(y).cast("int"))
        return (a[0] == b[0]) & (a[1] == b[1]) & (a[2] == b[2])

    def exact() -> Column:
        own = F.array_sort(F.transform(places, lambda i: F.struct(*[w.alias(f"w{k}") for k, w in enumerate(window(i))], i.cast("long").alias("i"))))

        def marked(s: Column) -> Column:
            def equal(x: Column, y: Column) -> Column:
                return F.coalesce((x["w0"] == y["w0"]) & (x["w1"] == y["w1"]) & (x["w2"] == y["w2"]), F.lit(False))

            return covered(F.transform(F.filter(s, lambda x, i: equal(x, F.get(s, i - 1)) | equal(x, F.get(s, i + 1))), lambda x: x["i"]))

        return let(own, marked)

    packed = F.sort_array(F.transform(places, lambda i: F.shiftleft(F.xxhash64(*window(i)), _AT).bitwiseOR(i.cast("long"))))

    def fast(s: Column) -> Column:
        twice = F.filter(s, lambda x, i: alike(x, F.get(s, i - 1)) | alike(x, F.get(s, i + 1)))

        def counted(t: Column) -> Column:
            clash = F.exists(F.transform(t, lambda x, i: alike(x, F.get(t, i + 1)) & ~same(x, F.coalesce(F.get(t, i + 1), x))), lambda c: c)
            return F.when(F.size(t) == 0, F.lit(0).cast("long")).when(clash, exact()).otherwise(covered(F.transform(t, place)))

        return let(twice, counted)

    return F.when(F.size(ws) < 3, F.lit(0).cast("long")).when(F.size(ws) > (1 << _AT), exact()).otherwise(let(packed, fast))


def base_rules(docs: DataFrame, host: str) -> DataFrame:
    """doc_id, host, text hash, the base counts and base_failed."""
    own = docs.select("doc_id", F.col(host).cast("string").alias("host"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    own = own.withColumn("words", words(F.col("text"))).withColumn("worded", F.filter(F.split("text", "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != ""))
    return own.select(
        "doc_id",
        "host",
        "text",
        F.xxhash64("text").alias("digest"),
        F.size("words").cast("long").alias("n_words"),
        F.length(F.regexp_replace("text", BLANK_RUN, "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("worded") - F.size(F.array_distinct("worded"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("words")).alias("n_repeat_words"),
    ).withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50))


def _lines(text: Column) -> Column:
    """Normalised worded lines: hash and number of words."""

    def one(line: Column) -> Column:
        words = F.split(F.regexp_replace(F.lower(line), "[0-9]+", "0"), BLANK_RUN)
        return let(words, lambda ws: F.struct(F.xxhash64(ws).alias("h"), F.size(ws).cast("long").alias("w"), F.length(line).alias("n")))

    return F.transform(F.filter(F.transform(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(BLANKS))), lambda x: x != ""), one)


def frequent_lines(docs: DataFrame, host: str, min_docs: int = MIN_DOCS, max_share: float = MAX_SHARE) -> DataFrame:
    """(host, h) of the lines above their host's limit."""
    own = docs.where("text is not null").select(F.col(host).cast("string").alias("host"), F.xxhash64(F.col("text").cast("string")).alias("copy"), _lines(F.col("text").cast("string")).alias("lines"))
    # equal texts of a host meet before their lines are exploded
    texts = own.groupBy("host", "copy").agg(F.first("lines").alias("lines"))
    seen = texts.select("host", F.explode(F.array_distinct(F.transform("lines", lambda x: x["h"]))).alias("h"))
    counts = seen.groupBy("host", "h").agg(F.count(F.lit(1)).alias("docs"))
    hosts = docs.groupBy(F.col(host).cast("string").alias("own")).agg(F.count(F.lit(1)).alias("total"))
    limited = counts.where(F.col("docs") > min_docs).join(hosts, F.col("host").eqNullSafe(F.col("own")))
    return limited.where(F.col("docs") > F.col("total") * max_share).select("host", "h")


def quality(docs: DataFrame, host: str = "source", min_docs: int = MIN_DOCS, max_share: float = MAX_SHARE, min_left: float = MIN_LEFT) -> DataFrame:
    """Per document: doc_id, digest, the base counts, base_failed, left_words, kept."""
    frequent = checkpointed(frequent_lines(docs, host, min_docs, max_share))
    frequent = broadcast_if_small(frequent.select(F.col("host").alias("f_host"), F.col("h").alias("f_h")), frequent.count(), BROADCAST_ROWS)
    base = base_rules(docs, host)
    key = ["doc_id", "digest", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    lines = base.select(*key, "host", F.posexplode_outer(_lines(F.col("text"))).alias("at", "line"))
    marked = lines.join(frequent, F.col("host").eqNullSafe(F.col("f_host")) & (F.col("line.h") == F.col("f_h")), "left")
    left = marked.groupBy(*key).agg(
        F.sum(F.when(F.coalesce("at", F.lit(0)) == 0, 1).otherwise(0)).alias("copies"),
        F.coalesce(F.sum(F.when(F.col("f_h").isNull(), F.col("line.w"))), F.lit(0)).alias("left"),
    )
    # repeated rows have met in one group: their sums are multiples
    out = left.withColumn("left_words", (F.col("left") / F.col("copies")).cast("long")).withColumn("one", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return out.select(*key, "left_words", (~F.col("base_failed") & (F.col("left_words") >= F.col("n_words") * min_left)).alias("kept"))


def keep_good(docs: DataFrame, host: str = "source") -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns."""
    bad = checkpointed(quality(docs, host).where(~F.col("kept")).select(F.col("doc_id").alias("_bad_id"), F.col("digest").alias("_bad_digest")).distinct())
    bad = broadcast_if_small(bad, bad.count(), BROADCAST_ROWS)
    same = docs["doc_id"].eqNullSafe(bad["_bad_id"]) & (F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit(""))) == bad["_bad_digest"])
    return docs.join(bad, same, "left_anti")
