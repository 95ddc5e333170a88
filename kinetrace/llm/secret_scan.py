"""Secrets by linking the parts of a credential.

Regular expressions find assigned secrets, access keys and long hexadecimal keys, which are reported wherever they
stand. Parts that mean little alone are weak candidates: names of accounts, short or oddly named passwords, tokens
that look like keys. An interval join links identifiers, secrets and endpoints that start within SCOPE characters
of each other in one block of text, blocks being parted by blank lines; a weak candidate is reported only if a
part that completes it is among them. All of it is built-in functions: the join is a window over the parts of a
text with a range frame, so neither a product of parts nor a text travels.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from kinetrace.llm.common import table, text_of, written
from kinetrace.llm.pii import NO_PAIRS, pairs_of, running

KINDS = ("assign", "access", "hex")
_EQUALS = r"""["']?+\x20*+[:=]\x20*+["']?+"""
#: What secrets of each kind look like. Possessive, so that no character is tried twice; nothing that
#: follows could use what they give up.
PATTERNS = {
    "assign": rf"(?i)(password|passwd|secret|token|api_?key){_EQUALS}([A-Za-z0-9+/_.=-]++)",
    "access": r"AKIA[A-Z0-9]{12,}+",
    "hex": r"(?<![0-9a-f])[0-9a-f]{32,}+",
}
#: Weak candidates and endpoints.
WEAK = {
    "identifier": rf"(?i)(?:user(?:_?name)?|login|account|client_?id|key_?id|access_?key){_EQUALS}[A-Za-z0-9@._-]{{3,}}+",
    "endpoint": r"(?:https?|ftp|ssh|jdbc|postgresql|postgres|mysql|mongodb|redis|amqp|s3)(?:[+:][a-z]++)?://[^\x00-\x20\"'<>]++",
    "keyed": rf"(?i)(?:pwd|pass|passphrase|auth|bearer|credential|private_?key){_EQUALS}[A-Za-z0-9+/_.=-]{{4,}}+",
    "keylike": r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}+",
    "blank": r"\n[\x20\t\r]*+\n",
}
#: Least characters of an assigned secret, and of one that is weak; least of a token that mixes cases and digits.
ASSIGNED, WEAKLY_ASSIGNED, MIXED = 8, 4, 20
#: Parts of a credential start within so many characters of each other.
SCOPE = 300
_IDENTIFIER, _SECRET, _ENDPOINT, _BLANK = 1, 2, 3, 0


def with_matches(rows: DataFrame, name: str, pattern: str, where: Column | None = None) -> DataFrame:
    """Adds array<struct(start, end, value)> of the matches in ``text``, in code points, ends exclusive; texts that do
    not match at all, or fail ``where``, are searched once."""
    found = F.col("text").rlike(pattern) if where is None else where & F.col("text").rlike(pattern)
    rows = rows.withColumn("__pairs", F.when(found, pairs_of(F.col("text"), pattern)).otherwise(F.array().cast(NO_PAIRS)))
    rows = rows.withColumn("__steps", F.transform("__pairs", lambda x: (F.char_length(x["gap"]) + F.char_length(x["hit"])).cast("long")))
    rows = rows.withColumn("__ends", running(F.col("__steps"), lambda now, x: F.greatest(now, F.lit(0)) + x))

    def place(x: Column, i: Column) -> Column:
        end = F.element_at("__ends", i + 1)
        return F.struct((end - F.char_length(x["hit"])).cast("int").alias("start"), end.cast("int").alias("end"), x["hit"].alias("value"))

    return rows.withColumn(name, F.transform("__pairs", place)).drop("__pairs", "__steps", "__ends")


def _assigned(value: Column) -> Column:
    return F.char_length(F.regexp_extract(value, PATTERNS["assign"], 2))


def _looks_like_a_key(value: Column) -> Column:
    """16 hexadecimal digits or more, or MIXED characters in both cases and with a digit."""
    digit = value.rlike("[0-9]")
    mixed = (F.char_length(value) >= MIXED) & value.rlike("[A-Z]") & value.rlike("[a-z]")
    return digit & (mixed | value.rlike("^[0-9a-f]*+$") & value.rlike("[a-f]"))


def scan(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, h, assign, access, hex, parts): the secrets of each text by kind, array<struct(start, end)>, and all parts
    of credentials, array<struct(start, end, role, kind, rank)>. rank is 0 for secrets, 1 for endpoints and weak
    candidates that a word names, 2 for tokens. h is a hash of the text, so rows that share an id stay apart."""
    rows = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text")).withColumn("h", F.xxhash64("text"))
    for kind in KINDS:
        rows = with_matches(rows, kind, PATTERNS[kind])
    rows = rows.withColumns({"assign": F.filter("assign", lambda m: _assigned(m["value"]) >= ASSIGNED), "short": F.filter("assign", lambda m: _assigned(m["value"]).between(WEAKLY_ASSIGNED, ASSIGNED - 1))})
    for name in ("identifier", "endpoint"):
        rows = with_matches(rows, name, WEAK[name])
    complement = (F.size("identifier") > 0) | (F.size("endpoint") > 0) | (F.size("access") > 0)
    for name in ("keyed", "keylike", "blank"):
        rows = with_matches(rows, name, WEAK[name], complement)
    rows = rows.withColumn("keylike", F.filter("keylike", lambda m: _looks_like_a_key(m["value"])))

    def parts(name: str, role: int, kind: int, rank: int) -> Column:
        return F.transform(name, lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), F.lit(role).alias("role"), F.lit(kind).alias("kind"), F.lit(rank).alias("rank")))

    every = F.concat(
        parts("assign", _SECRET, 0, 0), parts("access", _IDENTIFIER, 1, 0), parts("hex", _SECRET, 2, 0), parts("short", _SECRET, 0, 1), parts("keyed", _SECRET, 0, 1),
        parts("identifier", _IDENTIFIER, 1, 1), parts("endpoint", _ENDPOINT, -1, 1), parts("keylike", _SECRET, 2, 2), parts("blank", _BLANK, -1, 0),
    )
    only = lambda c: F.transform(c, lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"))).alias(c)
    return rows.select("doc_id", "h", *[only(k) for k in KINDS], every.alias("parts"))


def linked(parts: DataFrame) -> DataFrame:
    """The parts of each text that are identifiers or secrets, with block, identifier and endpoint: the nearest of each,
    struct(start, end), that stands in the same block within SCOPE; and secrets, how many do. ``parts`` has (doc_id, h,
    start, end, role, kind, rank), each part once. A weak candidate that overlaps a part of lower rank is not a
    part."""
    text = Window.partitionBy("doc_id", "h").orderBy("start", "end", "role", "kind", "rank")
    before = text.rowsBetween(Window.unboundedPreceding, -1)
    backward = Window.partitionBy("doc_id", "h").orderBy(*[F.desc(c) for c in ("start", "end", "role", "kind", "rank")]).rowsBetween(Window.unboundedPreceding, -1)
    real = F.col("role") != _BLANK
    for below in (1, 2):
        lower = real & (F.col("rank") < below)
        parts = parts.withColumn("over", F.max(F.when(lower, F.col("end"))).over(before)).withColumn("under", F.min(F.when(lower, F.col("start"))).over(backward))
        hit = (F.coalesce("over", F.lit(-1)) > F.col("start")) | (F.coalesce("under", F.col("end")) < F.col("end"))
        parts = parts.withColumn(f"hit{below}", hit & (F.col("rank") == below)).drop("over", "under")
    parts = parts.withColumn("block", F.sum((~real).cast("int")).over(text.rowsBetween(Window.unboundedPreceding, 0)))
    parts = parts.where(real & ~F.col("hit1") & ~F.col("hit2")).drop("hit1", "hit2")
    near = Window.partitionBy("doc_id", "h", "block").orderBy("start")
    around, left, right = near.rangeBetween(-SCOPE, SCOPE), near.rangeBetween(-SCOPE, 0), near.rangeBetween(0, SCOPE)

    def nearest(role: int) -> Column:
        span = F.when(F.col("role") == role, F.struct("start", "end"))
        l, r = F.max(span).over(left), F.min(span).over(right)
        return F.when(l.isNull() | (r["start"] - F.col("start") < F.col("start") - l["start"]), r).otherwise(l)

    out = parts.withColumns({"identifier": nearest(_IDENTIFIER), "endpoint": nearest(_ENDPOINT), "secrets": F.sum((F.col("role") == _SECRET).cast("int")).over(around)})
    return out.where(F.col("role") != _ENDPOINT)


def reported() -> Column:
    """Whether a weak part of ``linked`` is completed: an identifier by a secret, a secret that a word names by an
    identifier or an endpoint, a token by an identifier."""
    identifier = (F.col("role") == _IDENTIFIER) & (F.col("secrets") > 0)
    named = (F.col("rank") == 1) & (F.col("identifier").isNotNull() | F.col("endpoint").isNotNull())
    return (F.col("rank") > 0) & (identifier | (F.col("role") == _SECRET) & (named | F.col("identifier").isNotNull()))


def _shown(spans: Column) -> Column:
    """``spans`` is array<struct(start, kind, end)>."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base, spans, n_linked) of every row of ``docs``; base and spans are
    array<struct(start, kind, end)>, spans with the weak candidates that are reported; kind counts KINDS from 0.
    n_linked is the number of secrets in spans with an identifier or endpoint beside them.

    Null and empty texts have none. Rows that repeat get the same values. An empty table gives no rows; other
    columns play no part, whatever their names.
    """
    seen = written(scan(docs, id_col, text_col), "secrets")
    parts = seen.where(F.exists("parts", lambda p: p["role"].isin(_IDENTIFIER, _ENDPOINT))).select("doc_id", "h", F.explode("parts").alias("p")).select("doc_id", "h", "p.*").distinct()
    links = linked(parts).where(reported() | (F.col("rank") == 0))
    span = F.struct("start", "kind", "end")
    with_other = (F.col("role") == _SECRET) & (F.col("identifier").isNotNull() | F.col("endpoint").isNotNull())
    found = links.groupBy("doc_id", "h").agg(F.collect_set(F.when(F.col("rank") > 0, span)).alias("more"), F.count(F.when(with_other, 1)).alias("links"))
    found = found.select(F.col("doc_id").alias("id_"), F.col("h").alias("h_"), "more", "links")
    out = seen.drop("parts").join(found, F.col("doc_id").eqNullSafe(F.col("id_")) & (F.col("h") == F.col("h_")), "left")

    def with_kind(found: str, kind: int) -> Column:
        return F.transform(found, lambda m: F.struct(m["start"].alias("start"), F.lit(kind).alias("kind"), m["end"].alias("end")))

    out = out.withColumn("base", F.array_sort(F.concat(*[with_kind(k, i) for i, k in enumerate(KINDS)])))
    spans = F.when(F.col("more").isNull(), F.col("base")).otherwise(F.array_sort(F.array_distinct(F.concat("base", "more"))))
    return out.select("doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS], "base", spans.alias("spans"), F.coalesce("links", F.lit(0)).cast("long").alias("n_linked"))


def op12_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents"))
    return found.select("doc_id", *[f"n_{k}" for k in KINDS], F.sha2(_shown(F.col("base")), 256).alias("base_sha256"), _shown(F.col("spans")).alias("spans"), "n_linked")


#: The same patterns without look-behind and possessive quantifiers, which change the time and not the matches.
ORACLE = r"""
WITH p(name, pat) AS (VALUES
  ('assign', '([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)'),
  ('access', 'AKIA[A-Z0-9]+'), ('hex', '[0-9a-f]{32,}'),
  ('identifier', '([Uu][Ss][Ee][Rr](_?[Nn][Aa][Mm][Ee])?|[Ll][Oo][Gg][Ii][Nn]|[Aa][Cc][Cc][Oo][Uu][Nn][Tt]|[Cc][Ll][Ii][Ee][Nn][Tt]_?[Ii][Dd]|[Kk][Ee][Yy]_?[Ii][Dd]|[Aa][Cc][Cc][Ee][Ss][Ss]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?[A-Za-z0-9@._-]{3,}'),
  ('endpoint', '(https?|ftp|ssh|jdbc|postgresql|postgres|mysql|mongodb|redis|amqp|s3)([+:][a-z]+)?://[^\x00-\x20"''<>]+'),
  ('keyed', '([Pp][Ww][Dd]|[Pp][Aa][Ss][Ss]|[Pp][Aa][Ss][Ss][Pp][Hh][Rr][Aa][Ss][Ee]|[Aa][Uu][Tt][Hh]|[Bb][Ee][Aa][Rr][Ee][Rr]|[Cc][Rr][Ee][Dd][Ee][Nn][Tt][Ii][Aa][Ll]|[Pp][Rr][Ii][Vv][Aa][Tt][Ee]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?[A-Za-z0-9+/_.=-]{4,}'),
  ('keylike', '[A-Za-z0-9+/_=-]{16,}'), ('blank', '\n[\x20\t\r]*\n')),
d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
f AS (SELECT r, name, regexp_extract_all(t, pat) AS hits, string_split_regex(t, pat) AS gaps FROM d, p WHERE regexp_matches(t, pat)),
m AS (
  SELECT r, name, v, s, s + length(v) AS e, length(regexp_extract(v, '["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)$', 1)) AS n, length(v) AS l
  FROM (SELECT r, name, unnest(hits) AS v, unnest(list_transform(range(1, len(hits) + 1), lambda i: list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0))) AS s FROM f)),
base AS (
  SELECT r, s, e, CASE name WHEN 'assign' THEN 0 WHEN 'access' THEN 1 ELSE 2 END AS k FROM m
  WHERE name = 'assign' AND n >= 8 OR name = 'access' AND l >= 16 OR name = 'hex' AND l >= 32),
parts AS (
  SELECT DISTINCT r, CAST(s AS BIGINT) AS s, e, role, k, rank FROM (
    SELECT r, s, e, CASE k WHEN 1 THEN 1 ELSE 2 END AS role, k, 0 AS rank FROM base
    UNION ALL SELECT r, s, e, 2, 0, 1 FROM m WHERE name = 'keyed' OR name = 'assign' AND n BETWEEN 4 AND 7
    UNION ALL SELECT r, s, e, 1, 1, 1 FROM m WHERE name = 'identifier'
    UNION ALL SELECT r, s, e, 3, -1, 1 FROM m WHERE name = 'endpoint'
    UNION ALL SELECT r, s, e, 2, 2, 2 FROM m WHERE name = 'keylike' AND l >= 16 AND regexp_matches(v, '[0-9]') AND (l >= 20 AND regexp_matches(v, '[A-Z]') AND regexp_matches(v, '[a-z]') OR regexp_full_match(v, '[0-9a-f]*') AND regexp_matches(v, '[a-f]')))),
free AS (SELECT * FROM parts a WHERE NOT EXISTS (SELECT 1 FROM parts b WHERE b.r = a.r AND b.rank < a.rank AND b.s < a.e AND a.s < b.e)),
placed AS (SELECT *, (SELECT count(*) FROM m WHERE m.name = 'blank' AND m.r = free.r AND m.s <= free.s) AS block FROM free),
near AS (
  SELECT *, count(*) FILTER (role = 1) OVER w AS ids, count(*) FILTER (role = 2) OVER w AS secrets, count(*) FILTER (role = 3) OVER w AS ends
  FROM placed WINDOW w AS (PARTITION BY r, block ORDER BY s RANGE BETWEEN 300 PRECEDING AND 300 FOLLOWING)),
told AS (SELECT * FROM near WHERE rank > 0 AND (role = 1 AND secrets > 0 OR role = 2 AND (ids > 0 OR rank = 1 AND ends > 0))),
spans AS (SELECT r, s, k, e FROM base UNION SELECT r, s, k, e FROM told),
names AS (SELECT ['assign', 'access', 'hex'] AS names),
b AS (SELECT r, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex, string_agg(names[k + 1] || ':' || CAST(s AS BIGINT) || ':' || CAST(e AS BIGINT), ',' ORDER BY s, k) AS shown FROM base, names GROUP BY r),
a AS (SELECT r, string_agg(names[k + 1] || ':' || CAST(s AS BIGINT) || ':' || CAST(e AS BIGINT), ',' ORDER BY s, k, e) AS shown FROM spans, names GROUP BY r),
l AS (SELECT r, count(*) AS n FROM near WHERE role = 2 AND (ids > 0 OR ends > 0) AND (rank = 0 OR ids > 0 OR rank = 1) GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(b.shown, '')) AS base_sha256, coalesce(a.shown, '') AS spans, coalesce(l.n, 0) AS n_linked
FROM d LEFT JOIN b USING (r) LEFT JOIN a USING (r) LEFT JOIN l USING (r)
"""
