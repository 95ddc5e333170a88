"""Discovered spans against a plain version of the graph of patterns and instances."""

import collections
import math
import random

from pyspark.sql import functions as F

from kinetrace.llm import pii


def plain_patterns(mentions):
    """{pattern: (kind, score)} from (value, pattern, kind or None)."""
    edges = {}
    for value, pattern, kind in mentions:
        edges[pattern, value] = max(edges.get((pattern, value), -1), -1 if kind is None else kind)
    held = collections.defaultdict(set)
    for pattern, value in edges:
        held[pattern].add(value)
    held = {p: vs for p, vs in held.items() if len(vs) >= pii.SUPPORT}
    kinds = collections.defaultdict(lambda: -1)
    for p, vs in held.items():
        for v in vs:
            kinds[v] = max(kinds[v], edges[p, v])
    seeds = {v: (k, 1.0) for v, k in kinds.items() if k >= 0}
    known, good = dict(seeds), {}
    while True:
        fresh = {}
        for p, vs in held.items():
            if p not in good:
                scores = collections.defaultdict(float)
                for v in vs:
                    if v in known:
                        scores[known[v][0]] += known[v][1]
                best = max(((s / len(vs), -k) for k, s in scores.items()), default=(0, 0))
                if best[0] >= pii.CONFIDENCE:
                    fresh[p] = (-best[1], best[0])
        if not fresh:
            return good
        good |= fresh
        known = dict(seeds)
        for v in {v for p in good for v in held[p]} - set(seeds):
            doubt = collections.defaultdict(float)
            for p, (k, s) in good.items():
                if v in held[p]:
                    doubt[k] += math.log(max(1e-6, 1 - s))
            worth, k = max((1 - math.exp(d), -k) for k, d in doubt.items())
            known[v] = (-k, worth)


def checked(spark, texts):
    docs = spark.createDataFrame(texts, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("id_", "h_", "more", "base", "pattern", "m")})
    seen = pii.scan(docs, "doc_id", "text").collect()
    good = plain_patterns([(m.value, m.pattern, m.kind) for r in seen for m in r.mentions])
    want = collections.Counter()
    for r in seen:
        spans = {(s.start, s.kind, s.end) for s in r.base} | {(m.start, good[m.pattern][0], m.end) for m in r.mentions if m.kind is None and m.pattern in good}
        want[r.doc_id, ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))] += 1
    assert collections.Counter((r.doc_id, r.spans) for r in pii.find_pii(docs).collect()) == want
    return good, want


NAMES = ("alpha", "bravo", "delta", "gamma", "kappa", "omega", "sigma")


def test_each_hop_leads_to_the_next(spark):
    texts = []
    for k, name in enumerate(NAMES):
        texts += [f"write {name}: user{k}x{j}@mail{j}.org now" for j in range(9)]
        texts += [f"write {name}: agent{k}-00{k} now", f"write {name}: agent{k + 1}-00{k + 1} now"]
    good, want = checked(spark, [*enumerate(texts), (None, None), (3, ""), (4, texts[10]), (4, texts[10])])
    found = [k for k, v in want.items() if "email" in k[1] and "@" not in texts[k[0]]]
    assert len(found) == 2 * len(NAMES) and len(good) == len(NAMES)


def test_a_pattern_does_not_confirm_itself(spark):
    texts = [f"write here: user{j}@mail.org now" for j in range(8)] + ["write here: agent-001 now", "write here: agent-002 now"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    mentions = pii.scan(docs, "doc_id", "text").select(F.explode("mentions").alias("m")).select("m.*")
    (r,) = pii.confident_patterns(mentions.select("value", "pattern", "kind")).collect()
    assert abs(r.score - 0.8) < 1e-12


def test_random_graphs(spark):
    rng = random.Random(4)
    texts = []
    for i in range(400):
        value = rng.choice([f"u{rng.randrange(40)}@m.org", f"10.0.0.{rng.randrange(30)}", f"agent-{rng.randrange(30):03}", f"+1 (212) 555-{7000 + rng.randrange(20)}"])
        texts.append((i if i % 7 else None, f"say {rng.choice(NAMES)} {rng.choice(('to', 'at', 'by'))} {value}{rng.choice(' ,')} and {rng.choice(NAMES)} agent-{rng.randrange(20):03}"))
    checked(spark, texts)
