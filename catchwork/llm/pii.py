"""Personal data by bootstrapped contextual extraction, in Spark's own functions.

Base rules find e-mail addresses, IPv4 addresses, card numbers (Luhn) and telephone numbers; these are the seeds. Identifier-like
tokens (with a digit, or a seed) stand in a graph with the lexical patterns around them: the word before, the two words
before, and the word after. Seeds score 1. In each round a pattern's confidence is the mean score of its
instances' occurrences, one uncertain occurrence added, and an unseen instance's score is the greatest confidence among its
patterns that have enough support. After the rounds, unseen tokens of six or more characters under a pattern of high
confidence are personal data of kind ``id``. Base spans always stay.

Patterns and scores are grouped sums over all texts and joins on the pattern or instance, combined map-side; nothing is
collected to the driver but the number of confident patterns.

Cases: null text is empty. Repeated rows give repeated result rows. Texts of any length are processed whole. Other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.stage import broadcast_if_small, checkpointed
from .native import let, words

KINDS = ["email", "ip", "card", "phone", "id"]
# The contract's patterns; look-behinds and possessive repeats only spare the matcher retries that cannot succeed.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
TOKEN = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9]*+[0-9][^\x20\x09-\x0D]*+"
ROUNDS = 3
SUPPORT = 5
CONFIDENT = 0.9
SHORTEST = 6
BROADCAST_ROWS = 100_000
_SPANS = "array<struct<start:bigint,end:bigint,hit:string>>"
_PLACES = "array<struct<start:bigint,end:bigint>>"
_TOKENS = "array<struct<start:bigint,end:bigint,instance:string,seed:boolean,patterns:array<string>>>"
#: Matches whose places are added up together: sums over blocks keep very many matches of a text near linear.
BLOCK = 128


def located(text: Column, pattern: str) -> Column:
    """The pattern's matches with their places, within the row.

    Lengths of the pieces between matches and of the matches add up to the places: first over whole blocks, then within each
    block, so no part of the text is walked again for each match.
    """
    none = F.array().cast(_SPANS)
    state = f"struct<at:bigint,out:{_SPANS}>"

    def placed(p: Column) -> Column:
        hits, gaps = p["hits"], p["gaps"]
        n = F.size(hits)
        blocks = F.sequence(F.lit(0), F.ceil(n / BLOCK).cast("int") - 1)
        ids = lambda b: F.sequence(b * BLOCK, F.least((b + 1) * BLOCK, n) - 1)

        def step(a: Column, i: Column) -> Column:
            hit = F.get(hits, i)
            begin = a["at"] + F.length(F.get(gaps, i))
            end = begin + F.length(hit)
            span = F.struct(begin.alias("start"), end.alias("end"), hit.alias("hit"))
            return F.struct(end.alias("at"), F.concat(a["out"], F.array(span)).alias("out")).cast(state)

        length = lambda b: F.aggregate(ids(b), F.lit(0).cast("bigint"), lambda t, i: t + F.length(F.get(gaps, i)) + F.length(F.get(hits, i)))
        offsets = F.aggregate(blocks, F.array(F.lit(0).cast("bigint")), lambda t, b: F.concat(t, F.array(F.element_at(t, -1) + length(b))))

        def of_block(o: Column, b: Column) -> Column:
            return F.aggregate(ids(b), F.struct(F.get(o, b).alias("at"), none.alias("out")).cast(state), step)["out"]

        return F.when(n == 0, none).otherwise(let(offsets, lambda o: F.flatten(F.transform(blocks, lambda b: of_block(o, b)))))

    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return let(F.struct(hits.alias("hits"), F.split(text, pattern, -1).alias("gaps")), placed)


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def _byte(part: Column) -> Column:
    bare = F.ltrim(part, F.lit("0"))
    return (F.length(bare) <= 2) | ((F.length(bare) == 3) & (bare <= "255"))


def _luhn(digits: Column) -> Column:
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return total + F.when((n - i) % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


def _is_card(hit: Column) -> Column:
    return let(_digits(hit), lambda d: F.when(F.length(d).between(16, 19), _luhn(d)).otherwise(F.lit(False)))


#: Kind: pattern, a character or class that a text with a match holds, and the test of a match.
RULES: dict[str, tuple[str, str, Callable[[Column], Column]]] = {
    "email": (EMAIL, "@", lambda h: F.lit(True)),
    "ip": (IP, "[0-9]", lambda h: F.forall(F.split(h, r"\."), _byte)),
    "card": (CARD, "[0-9]", _is_card),
    "phone": (PHONE, "+", lambda h: F.length(_digits(h)).between(8, 15)),
}


def _base(text: Column, kind: str) -> Column:
    pattern, needs, good = RULES[kind]
    may = text.rlike(needs) if needs.startswith("[") else F.contains(text, F.lit(needs))
    return F.when(may, F.filter(located(text, pattern), lambda x: good(x["hit"]))).otherwise(F.array().cast(_SPANS))


def _is_seed(token: Column) -> Column:
    """Whether a token holds a base match of its own."""
    ip = F.regexp_extract(token, IP, 0)
    card = F.regexp_extract(token, CARD, 0)
    return (F.contains(token, F.lit("@")) & token.rlike(EMAIL)) | ((ip != "") & RULES["ip"][2](ip)) | ((card != "") & _is_card(card)) | (F.contains(token, F.lit("+")) & F.length(_digits(F.regexp_extract(token, PHONE, 0))).between(8, 15))


def scan(docs: DataFrame) -> DataFrame:
    """(uid, doc_id, digest, email, ip, card, phone, tokens): spans by kind, and tokens with their contexts; the text is read once."""
    text = F.col("text")
    own = docs.select(F.monotonically_increasing_id().alias("uid"), "doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    digits = lambda c: F.when(text.rlike("[0-9]"), c).otherwise(F.array().cast(_SPANS))
    own = own.select("*", F.xxhash64("text").alias("digest"), *[_base(text, k).alias(k) for k in RULES], digits(located(text, TOKEN)).alias("runs"))
    # seeds that are no token: of several words, or without a digit; they stand from their first word to their last
    other = F.filter(F.concat(*[F.col(k) for k in RULES]), lambda s: s["hit"].rlike(r"[\x20\x09-\x0D]") | ~s["hit"].rlike("[0-9]"))
    wanted = (F.size("runs") > 0) | (F.size("other") > 0)
    own = own.withColumn("other", other).withColumn("words", F.when(wanted, words(text)).otherwise(F.array().cast("array<string>")))

    def patterns(left: Column, two: Column, right: Column) -> Column:
        """The word before, the two words before, the word after; null where the text has none."""
        named = lambda kind, c: F.concat(F.lit(kind), F.lower(c))
        return F.array(named("l:", left), named("b:", two), named("r:", right))

    # tokens are the words with a digit, in their order
    places = F.filter(F.sequence(F.lit(0), F.size("words") - 1), lambda i: F.get("words", i).rlike("[0-9]"))

    def token(t: Column, k: Column, at: Column) -> Column:
        i = F.get(at, k)
        around = patterns(F.get("words", i - 1), F.concat(F.get("words", i - 2), F.lit(" "), F.get("words", i - 1)), F.get("words", i + 1))
        return F.struct(t["start"].alias("start"), t["end"].alias("end"), F.lower(t["hit"]).alias("instance"), _is_seed(t["hit"]).alias("seed"), around.alias("patterns"))

    tokens = F.when(F.size("runs") == 0, F.array().cast(_TOKENS)).otherwise(let(places, lambda at: F.transform("runs", lambda t, k: token(t, k, at))))
    # other seeds: the word that begins at or holds their start is found by counting the blank runs before it
    blanked = F.when(F.size("other") > 0, located(text, r"[^\x20\x09-\x0D]+")).otherwise(F.array().cast(_SPANS))

    def seed(s: Column, every: Column) -> Column:
        # words are sorted by place, so the numbers of words that end by the start and begin before the end are binary searches
        first, after = _count(every, lambda w: w["end"] <= s["start"]), _count(every, lambda w: w["start"] < s["end"])
        word = lambda i: F.get(every, i)["hit"]
        around = patterns(word(first - 1), F.concat(word(first - 2), F.lit(" "), word(first - 1)), word(after))
        return F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lower(s["hit"]).alias("instance"), F.lit(True).alias("seed"), around.alias("patterns"))

    seeds = F.when(F.size("other") == 0, F.array().cast(_TOKENS)).otherwise(let(blanked, lambda every: F.transform("other", lambda s: seed(s, every))))
    at = lambda k: F.transform(k, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))).cast(_PLACES)
    return own.select("uid", "doc_id", "digest", *[at(k).alias(k) for k in RULES], F.concat(tokens, seeds).alias("tokens"))


def _count(every: Column, holds: Callable[[Column], Column]) -> Column:
    """How many elements, from the first on, ``holds`` is true of: a binary search, 31 steps for any array."""
    step = lambda n, k: F.when(n + k <= F.size(every), F.when(holds(F.get(every, n + k - 1)), n + k).otherwise(n)).otherwise(n)
    return F.aggregate(F.array(*[F.lit(1 << b) for b in range(30, -1, -1)]), F.lit(0), step)


def confident_patterns(rows: DataFrame, rounds: int = ROUNDS, support: int = SUPPORT, confident: float = CONFIDENT) -> DataFrame:
    """(pattern): lexical patterns whose instances are personal data with high confidence."""
    seen = rows.select(F.explode("tokens").alias("t")).select("t.instance", "t.seed", F.explode("t.patterns").alias("pattern")).where("pattern is not null")
    edges = checkpointed(seen.groupBy("pattern", "instance").agg(F.count(F.lit(1)).alias("n"), F.max(F.col("seed").cast("double")).alias("seed")))
    scored = edges.withColumn("score", F.col("seed"))
    for k in range(rounds):
        patterns = scored.groupBy("pattern").agg((F.sum(F.col("n") * F.col("score")) / (F.sum("n") + 1)).alias("confidence"), F.count(F.lit(1)).alias("instances"))
        if k == rounds - 1:
            return patterns.where((F.col("confidence") >= confident) & (F.col("instances") >= support)).select("pattern")
        strong = checkpointed(patterns.where(F.col("instances") >= support).select("pattern", "confidence"))
        strong = broadcast_if_small(strong, strong.count(), BROADCAST_ROWS)  # a frequent pattern is no hot key then
        unseen = edges.where("seed = 0").join(strong, "pattern").groupBy("instance").agg(F.max("confidence").alias("found"))
        scored = edges.join(unseen, "instance", "left").withColumn("score", F.when(F.col("seed") > 0, F.lit(1.0)).otherwise(F.coalesce("found", F.lit(0.0))))
    raise ValueError("at least one round is needed")


def apart(rows: DataFrame, found: DataFrame) -> DataFrame:
    """The spans ``found`` (uid, start, end) that overlap no base span: one sweep over the spans of a text in their order."""
    spans = F.explode(F.concat(*[F.col(k) for k in RULES])).alias("s")
    base = rows.join(found.select("uid").distinct(), "uid", "left_semi").select("uid", spans).select("uid", "s.start", "s.end", F.lit(True).alias("base"))
    every = found.withColumn("base", F.lit(False)).unionByName(base)
    w = Window.partitionBy("uid").orderBy("start", F.col("base").desc())
    reach = F.max(F.when(F.col("base"), F.col("end"))).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ahead = F.min(F.when(F.col("base"), F.col("start"))).over(Window.partitionBy("uid").orderBy(F.desc("start"), "base").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    swept = every.select("uid", "start", "end", "base", reach.alias("reach"), ahead.alias("ahead"))
    return swept.where(~F.col("base") & (F.coalesce("reach", F.lit(-1)) <= F.col("start")) & (F.coalesce("ahead", F.col("end")) >= F.col("end"))).select("uid", "start", "end")


def personal_data(docs: DataFrame, rounds: int = ROUNDS, support: int = SUPPORT, confident: float = CONFIDENT) -> DataFrame:
    """Per document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, found (array of kind, start, end), digest of the text."""
    rows = checkpointed(scan(docs))
    patterns = checkpointed(confident_patterns(rows, rounds, support, confident))
    patterns = broadcast_if_small(patterns, patterns.count(), BROADCAST_ROWS)
    unseen = rows.select("uid", F.explode(F.filter("tokens", lambda t: ~t["seed"] & (t["end"] - t["start"] >= SHORTEST))).alias("t"))
    hits = unseen.select("uid", "t.start", "t.end", F.explode("t.patterns").alias("pattern")).join(patterns, "pattern")
    extra = apart(rows, hits.select("uid", "start", "end").distinct()).groupBy("uid").agg(F.collect_list(F.struct("start", "end")).alias("id"))
    every = rows.select("uid", "doc_id", "digest", *RULES).join(extra, "uid", "left")
    every = every.withColumn("id", F.coalesce("id", F.array().cast(_PLACES)))

    def of(kind: str) -> Column:
        ordered = F.array_sort(F.col(kind))
        return F.transform(ordered, lambda x: F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end")))

    def listed(found: Column) -> Column:
        return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")

    base, found = F.concat(*[of(k) for k in KINDS[:4]]), F.concat(*[of(k) for k in KINDS])
    return every.select("doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in RULES], F.sha2(listed(base), 256).alias("base_sha256"), listed(found).alias("spans"), found.alias("found"), "digest")


def merged(found: DataFrame) -> DataFrame:
    """Spans (keys, start, end, kind) of each text merged where they overlap; the first and longest gives the kind: one sweep in their order."""
    keys = [c for c in found.columns if c not in ("start", "end", "kind")]
    before = Window.partitionBy(*keys).orderBy("start", F.desc("end"), "kind").rowsBetween(Window.unboundedPreceding, -1)
    upto = before.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    begins = found.withColumn("_new", (F.coalesce(F.max("end").over(before), F.lit(-1)) <= F.col("start")).cast("int"))
    placed = begins.withColumn("_island", F.sum("_new").over(upto))
    kind = F.min_by("kind", F.struct("start", -F.col("end"), "kind"))
    return placed.groupBy(*keys, "_island").agg(F.min("start").alias("start"), F.max("end").alias("end"), kind.alias("kind")).drop("_island")


#: Characters of the blocks that a text is cut into for redaction: a piece is taken from its own blocks.
PIECE = 1024


def redacted(text: Column, spans: Column) -> Column:
    """The text with its spans (sorted, apart: start, end, kind) replaced by their kinds in brackets."""

    def taken(blocks: Column, a: Column, b: Column) -> Column:
        first = F.floor(a / PIECE).cast("int")
        own = F.array_join(F.slice(blocks, first + 1, F.greatest(F.ceil(b / PIECE).cast("int") - first, F.lit(0))), "")
        return F.substring(own, (a - first * PIECE + 1).cast("int"), (b - a).cast("int"))

    def pieces(blocks: Column) -> Column:
        size = F.length(text).cast("long")
        before = lambda i: F.coalesce(F.get(spans, i - 1)["end"], F.lit(0).cast("long"))
        each = F.transform(spans, lambda x, i: F.concat(taken(blocks, before(i), x["start"]), F.lit("["), x["kind"], F.lit("]")))
        return F.concat(F.array_join(each, ""), taken(blocks, before(F.size(spans)), size))

    return let(F.regexp_extract_all(text, F.lit("(?s).{1,%d}" % PIECE), F.lit(0)), pieces)
