"""Personal data by bootstrapped contextual extraction.

Regular expressions find the seed entities. Every identifier-like token is an instance; what stands before
it and the character after it make a lexical pattern. Seeds are known instances at first. In each round
patterns are scored by the known instances they hold; those that are confident are accepted, and their other
instances become known of that kind, worth what their patterns are worth, so that they induce further patterns.
A pattern keeps the score it was accepted with, when none of its own guesses was known yet, so no pattern
confirms itself; the search ends with the first round that accepts none. All of it is built-in functions: folds over the matches of a text give the
places, joins and aggregations give the scores.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinetrace.llm.common import joined_evenly, table, text_of, written

KINDS = ("email", "ip", "card", "phone")
#: What the seeds of each kind look like. A seed may start only where no earlier start could
#: have reached it, which keeps the search linear in long runs and finds the same matches.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: An instance: a run of identifier characters, six or more, one of them a digit or an at sign.
_TOKEN = r"(?<![A-Za-z0-9._%+@:/-])(?=[A-Za-z._%+:/-]*+[0-9@])[A-Za-z0-9._%+@:/-]{6,}+"  # _LEAST
#: A pattern needs so many different instances and at least this score to discover others.
SUPPORT, CONFIDENCE = 5, 0.8
_LEFT = 40
#: Least characters of an instance: so many instances before one cover the characters on its left.
_LEAST = 6
NO_PAIRS = "array<struct<gap:string,hit:string,next:string>>"


def running(items: Column, step: Callable[[Column, Column], Column]) -> Column:
    """The state of a fold over longs, from -1, after each item. Blocks of the square root of their number are
    folded one by one, so that a long array is not copied for each of its items. ``items`` must be a plain
    column, as every block reads it."""
    size = F.greatest(F.lit(64), F.ceil(F.sqrt(F.size(items)))).cast("int")
    last_block = F.greatest(F.ceil(F.size(items) / size).cast("int") - 1, F.lit(0))
    blocks = F.transform(F.sequence(F.lit(0), last_block), lambda b: F.slice(items, b * size + 1, size))
    none, first = F.array().cast("array<bigint>"), F.lit(-1).cast("long")

    def grown(acc: Column, block: Column) -> Column:
        before = F.array(F.coalesce(F.try_element_at(F.try_element_at(acc, F.lit(-1)), F.lit(-1)), first))
        return F.concat(acc, F.array(F.aggregate(block, before, lambda a, x: F.concat(a, F.array(step(F.element_at(a, -1), x))), lambda a: F.slice(a, 2, F.size(a)))))

    return F.flatten(F.aggregate(blocks, F.array(none).cast("array<array<bigint>>"), grown))


def pairs_of(text: Column, pattern: str) -> Column:
    """array<struct(gap, hit, next)>: each match with the text between it and the matches around it."""
    between = F.split(text, pattern, -1)
    zipped = F.arrays_zip(between.alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit"), F.slice(between, 2, F.size(between)).alias("next"))
    return F.filter(zipped, lambda x: x["hit"].isNotNull())


def _with_places(rows: DataFrame, pairs: Column, name: str) -> DataFrame:
    """Adds array<struct(start, end, value, left, after)> of matches, in code points, the end exclusive: with the
    characters on the left, at most _LEFT, and the one after. They come from the matches before, so nothing is
    looked up by its place in a long text."""
    rows = rows.withColumn("__pairs", pairs)
    rows = rows.withColumn("__steps", F.transform("__pairs", lambda x: (F.char_length(x["gap"]) + F.char_length(x["hit"])).cast("long")))
    rows = rows.withColumn("__ends", running(F.col("__steps"), lambda now, x: F.greatest(now, F.lit(0)) + x))
    near = _LEFT // _LEAST + 1

    def left(i: Column) -> Column:
        first = F.greatest(i - near + 1, F.lit(1))
        before = F.transform(F.slice("__pairs", first, i + 1 - first), lambda x: F.concat(F.right(x["gap"], F.lit(_LEFT)), x["hit"]))
        return F.right(F.concat(F.array_join(before, ""), F.right(F.element_at("__pairs", i + 1)["gap"], F.lit(_LEFT))), F.lit(_LEFT))

    def place(x: Column, i: Column) -> Column:
        end = F.element_at("__ends", i + 1)
        return F.struct((end - F.char_length(x["hit"])).cast("int").alias("start"), end.cast("int").alias("end"), x["hit"].alias("value"), left(i).alias("left"), F.left(x["next"], F.lit(1)).alias("after"))

    return rows.withColumn(name, F.transform("__pairs", place)).drop("__pairs", "__steps", "__ends")


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    """Whether the digits of ``value`` pass Luhn's check."""
    digits = _digits(value)
    n = F.length(digits)

    def add(acc: Column, i: Column) -> Column:
        d = F.substring(digits, n - i + 1, F.lit(1)).cast("int")
        twice = F.when(d >= 5, 2 * d - 9).otherwise(2 * d)
        return acc + F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0), add) % 10 == 0


def _sound(kind: str, found: Column) -> Column:
    """The matches of a kind that are seeds."""
    if kind == "ip":
        return F.filter(found, lambda m: ~F.exists(F.split(m["value"], r"\."), lambda x: x.cast("double") > 255))
    if kind == "card":
        return F.filter(found, lambda m: luhn(m["value"]))
    return F.filter(found, lambda m: F.length(_digits(m["value"])).between(9, 15)) if kind == "phone" else found


def _with_seeds(rows: DataFrame) -> DataFrame:
    """Adds a column for each kind, array<struct(start, end, …)>; texts that lack a kind's sign are not searched."""
    text = F.col("text")
    signs = {"email": F.contains(text, F.lit("@")), "ip": text.rlike(PATTERNS["ip"]), "card": text.rlike(PATTERNS["card"]), "phone": F.contains(text, F.lit("+"))}
    for kind in KINDS:
        rows = _with_places(rows, F.when(signs[kind], pairs_of(text, PATTERNS[kind])).otherwise(F.array().cast(NO_PAIRS)), kind)
        rows = rows.withColumn(kind, _sound(kind, F.col(kind)))
    return rows


def _spans(kinds: dict[str, Column]) -> Column:
    """array<struct(start, kind index, end)> of all kinds, sorted by start, then by kind as listed."""
    def of(kind: str, found: Column) -> Column:
        number = F.lit(KINDS.index(kind))
        return F.transform(found, lambda m: F.struct(m["start"].alias("start"), number.alias("kind"), m["end"].alias("end")))

    return F.array_sort(F.concat(*[of(k, c) for k, c in kinds.items()]))


def _shown(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _context(m: Column) -> Column:
    """The two words before an instance, digits as 9, lower-cased, and the character after it."""
    left = F.regexp_extract(m["left"], r"(\S*\s*\S*\s*)$", 1)
    left = F.regexp_replace(F.regexp_replace(F.lower(left), "[0-9]", "9"), r"\s+", " ")
    return F.concat(left, F.lit("_"), m["after"])


def with_kinds(rows: DataFrame) -> DataFrame:
    """Adds kinds: for each of ``tokens`` the kind of a seed of ``base`` that it overlaps, or null. Seeds and tokens
    are sorted once; a fold carries the farthest end so far of a seed, one in reverse the next start of one, each
    with its kind in the last three bits."""
    seeds = F.transform("base", lambda s: F.struct(s["start"].alias("start"), F.lit(False).alias("token"), s["end"].alias("end"), s["kind"].alias("kind")))
    tokens = F.transform("tokens", lambda t: F.struct(t["start"].alias("start"), F.lit(True).alias("token"), t["end"].alias("end"), F.lit(None).cast("int").alias("kind")))
    coded = lambda edge: lambda e: F.when(e["token"], -1).otherwise(e[edge] * 8 + e["kind"]).cast("long")
    rows = rows.withColumn("__events", F.array_sort(F.concat(seeds, tokens)))
    rows = rows.withColumns({"__forth": F.transform("__events", coded("end")), "__back": F.reverse(F.transform("__events", coded("start")))})
    over = running(F.col("__forth"), lambda now, x: F.greatest(now, x))
    inside = F.reverse(running(F.col("__back"), lambda now, x: F.when(x < 0, now).otherwise(x)))
    rows = rows.withColumn("__found", F.filter(F.arrays_zip(F.col("__events").alias("e"), over.alias("over"), inside.alias("inside")), lambda z: z["e"]["token"]))
    kind = lambda z: F.when(F.shiftright(z["over"], 3) > z["e"]["start"], z["over"] % 8).when((z["inside"] >= 0) & (F.shiftright(z["inside"], 3) < z["e"]["end"]), z["inside"] % 8).cast("int")
    return rows.withColumn("kinds", F.transform("__found", kind)).drop("__events", "__forth", "__back", "__found")


def scan(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, h, base, n_email, n_ip, n_card, n_phone, mentions): the seeds of each text and its instances, each
    with its value, its pattern and the kind of a seed it overlaps, or null. Regular expressions and folds take
    time in proportion to the text; only the copies of folded longs grow faster, with the power 1.5 of the
    number of matches."""
    rows = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    rows = _with_seeds(rows.select("doc_id", F.xxhash64("text").alias("h"), "text"))
    rows = rows.withColumn("base", _spans({k: F.col(k) for k in KINDS}))
    pairs = F.when(F.col("text").rlike("[0-9@]"), pairs_of(F.col("text"), _TOKEN)).otherwise(F.array().cast(NO_PAIRS))
    rows = with_kinds(_with_places(rows, pairs, "tokens"))
    mentions = F.transform(F.arrays_zip("tokens", "kinds"), lambda z: F.struct(
        z["tokens"]["start"].alias("start"), z["tokens"]["end"].alias("end"), F.sha1(z["tokens"]["value"].cast("binary")).alias("value"),
        _context(z["tokens"]).alias("pattern"), z["kinds"].alias("kind"),
    ))
    return rows.select("doc_id", "h", "base", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS], mentions.alias("mentions"))


def confident_patterns(mentions: DataFrame, support: int = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """(pattern, found, score, size) of the patterns that may discover instances of the kind ``found``; size is how
    often a pattern occurs. ``mentions`` has (value, pattern, kind).

    A pattern's score for a kind is the sum of what its known instances of that kind are worth over the number
    of its different instances. An instance that a seed covers anywhere is worth 1; one that confident patterns
    hold is worth the chance that at least one of them is right. Patterns and instances that very many rows
    have are dealt over many tasks.
    """
    edges = written(mentions.groupBy("pattern", "value").agg(F.max("kind").alias("kind"), F.count(F.lit(1)).alias("m")), "edges")
    sizes = written(edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("n"), F.sum("m").alias("size")).where(F.col("n") >= support), "sizes")
    graph = written(joined_evenly(edges.drop("m"), sizes.withColumn("m", F.col("size")), "pattern", "m", ["value"]), "graph")
    values = written(graph.groupBy("value").agg(F.max("kind").alias("kind"), F.count(F.lit(1)).alias("uses")), "values")
    seeds = values.where("kind IS NOT NULL").select("value", F.col("kind").alias("of"), F.lit(1.0).alias("worth"), "uses")
    known, good = seeds, None
    while True:
        held = joined_evenly(graph.drop("kind"), known, "value", "uses", ["pattern"])
        scores = held.groupBy("pattern", "of", "n", "size").agg((F.sum("worth") / F.col("n")).alias("score"))
        best = scores.where(F.col("score") >= confidence).groupBy("pattern", "size").agg(F.max(F.struct("score", -F.col("of"), "of")).alias("b"))
        fresh = best.select("pattern", F.col("b.of").alias("found"), F.col("b.score").alias("score"), "size")
        if good is not None:
            fresh = fresh.join(good.select("pattern"), "pattern", "left_anti")
        fresh = written(fresh, "patterns")
        if good is not None and fresh.isEmpty():
            return good
        good = fresh if good is None else written(good.unionByName(fresh), "patterns")
        reached = joined_evenly(graph.drop("kind", "n", "size"), good, "pattern", "size", ["value"])
        doubt = F.sum(F.log(F.greatest(F.lit(1e-6), 1 - F.col("score"))))
        votes = reached.groupBy("value", "found").agg((1 - F.exp(doubt)).alias("worth")).groupBy("value").agg(F.max(F.struct("worth", -F.col("found"), "found")).alias("b"))
        more = values.where("kind IS NULL").join(votes, "value").select("value", F.col("b.found").alias("of"), F.col("b.worth").alias("worth"), "uses")
        known = written(seeds.unionByName(more), "known")


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) of every row of ``docs``.

    Counts and digest are those of the seeds; spans adds the discovered ones. Null and empty texts have
    none; rows that repeat get the same values; a corpus without seeds discovers nothing.
    """
    seen = written(scan(docs, id_col, text_col), "seeds")
    each = seen.where(F.size("mentions") > 0).select("doc_id", "h", F.explode("mentions").alias("m")).select("doc_id", "h", "m.*")
    good = confident_patterns(each.select("value", "pattern", "kind"))
    found = (
        joined_evenly(each.where("kind IS NULL").drop("value"), good, "pattern", "size", ["doc_id", "h", "start"]).groupBy("doc_id", "h")
        .agg(F.collect_set(F.struct("start", F.col("found").alias("kind"), "end")).alias("more"))
        .select(F.col("doc_id").alias("id_"), F.col("h").alias("h_"), "more")
    )
    out = seen.drop("mentions").join(found, F.col("doc_id").eqNullSafe(F.col("id_")) & (F.col("h") == F.col("h_")), "left")
    spans = F.when(F.col("more").isNull(), F.col("base")).otherwise(F.array_sort(F.concat("base", "more")))
    return out.select("doc_id", *[f"n_{k}" for k in KINDS], F.sha2(_shown(F.col("base")), 256).alias("base_sha256"), _shown(spans).alias("spans"))


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(table(spark, sf_dir, "documents"))
