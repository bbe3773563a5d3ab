from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter
from itertools import permutations

import pytest

from panelwave.llm.filter_audit import Diagram, adjacent_swaps, audit_part, failure_masks, interaction_audit
from panelwave.llm.lyndon_runs import collapse_runs, find_runs, lyndon_array, with_planted_runs
from panelwave.llm.prefix_decontam import _n_words, _words, find_contamination, text_words
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ITEM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def as_counter(rows):
    return Counter(tuple(r) for r in rows)


# Runs


def brute_lyndon(s):
    return [next((j for j in range(i + 1, len(s)) if s[j:] < s[i:]), len(s)) - i for i in range(len(s))]


def brute_runs(w, least=6, exponent=4):
    """Maximal stretches of words equal a period apart, from all periods and places."""
    found = {}
    for q in range(1, len(w) // exponent + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, exponent * q):
                found.setdefault((i, j + q - i), q)  # a multiple of a smaller period has the same stretch
            i = max(j, i + 1)
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def brute_collapse(words):
    runs = brute_runs(words)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    kept = " ".join(x for i, x in enumerate(words) if i not in gone)
    top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (len(runs), *top, sha(listed), sha(kept))


DIGEST = ("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


def test_lyndon_arrays_and_runs():
    rng = random.Random(1)
    for _ in range(1500):
        n, k = rng.randrange(0, 40), rng.choice([1, 2, 2, 3, 5])
        s = [rng.randrange(k) for _ in range(n)]
        if n and rng.random() < 0.5:
            a, p = rng.randrange(n), rng.randrange(1, 5)
            s = [x if i < a else s[min(a + (i - a) % p, n - 1)] for i, x in enumerate(s)]
        assert lyndon_array(s) == brute_lyndon(s)
        for least, exponent in ((6, 4), (2, 2), (4, 3)):
            assert find_runs(s, least, exponent) == brute_runs(s, least, exponent)


def test_collapse_against_brute_force(spark, odd, none):
    rng = random.Random(3)
    texts = [(r.doc_id, r.text) for r in odd.collect()]
    for i in range(150):
        words = [rng.choice("abcdefgh") + rng.choice(["", "x"]) for _ in range(rng.randrange(60))]
        for _ in range(rng.randrange(3)):
            unit = [rng.choice("abc") for _ in range(rng.randrange(1, 8))]
            at, size = rng.randrange(len(words) + 1), rng.randrange(3 * len(unit), 7 * len(unit))
            words[at:at] = (unit * 8)[:size]
        texts.append((100 + i, rng.choice([" ", "\n", " \t"]).join(words)))
    texts += [(400, " ".join(["long", "run"] * 20000)), (401, "same " * 5), (402, "same " * 6), (403, "Same same " * 3)]
    df = spark.createDataFrame(texts, "doc_id long, text string").withColumn("start", F.lit("x")).repartition(5)
    want = Counter((i, *brute_collapse(WORD.findall(t or ""))) for i, t in texts if i != 400)
    got = collapse_runs(df)
    assert as_counter(got.where("doc_id is null or doc_id <> 400").select("doc_id", *DIGEST).collect()) == want
    long = got.where("doc_id = 400").first()
    assert long.n_runs == 1 and (long.start, long.length, long.period) == (0, 40000, 2) and long.collapsed_text == "long run"
    assert collapse_runs(none).count() == 0
    named = collapse_runs(df.selectExpr("cast(doc_id as string) as name", "text"), doc_id="name", with_text=False)
    assert as_counter(named.where("name <> '400'").select(F.col("name").cast("long"), *DIGEST).collect()) == Counter(
        {k: v for k, v in want.items() if k[0] is not None}
    )


def test_planted_runs(spark, odd):
    def planted(i, text):
        w, h = WORD.findall(text or ""), zlib.crc32(str(i).encode())
        if i is None or h % 10 or not w:
            return w
        g, n = h // 10, len(w)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        return [w[j] if j < a else w[a + (j - a) % p] for j in range(n)]

    rng = random.Random(8)
    texts = [(r.doc_id, r.text) for r in odd.collect()]
    texts += [(i, " ".join(f"w{rng.randrange(50)}" for _ in range(rng.randrange(90)))) for i in range(100, 400)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    got = Counter((r.doc_id, tuple(WORD.findall(r.text or ""))) for r in with_planted_runs(df).collect())
    assert got == Counter((i, tuple(planted(i, t))) for i, t in texts)
    assert sum(zlib.crc32(str(i).encode()) % 10 == 0 for i in range(100, 400)) > 20


# Benchmark passages


def brute_hits(docs, items, span=10):
    def words(text):
        return ITEM_WORD.findall((text or "").translate(LOWER))

    windows = {}
    for i, text in items:
        w = words(text)
        n = min(len(w), span)
        for k in range(len(w) - n + 1 if w else 0):
            windows.setdefault(tuple(w[k : k + n]), set()).add("" if i is None else str(i))
    out = []
    for i, text in docs:
        w, hit, found = words(text), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                named = windows.get(tuple(w[k : k + n]))
                if named:
                    hit |= set(range(k, k + n))
                    found |= named
        out.append((i, len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit)))
    return Counter(out)


HITS = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def passages(rng):
    items = [(i, " ".join(f"v{rng.randrange(30)}" for _ in range(rng.randrange(8, 30)))) for i in range(20)]
    items += [(20, "one two three."), (21, "single"), (22, "Four little WORDS here"), (23, "..."), (24, None), (25, "")]
    items += [(26, items[0][1]), (0, items[1][1]), (None, "a nameless item of some more than ten words in all"), (21, "single")]
    items += [(27, "naïve ÉTÉ 漢字 42"), (28, "v1 v1 v1 v1 v1 v1 v1 v1 v1 v1 v1 v1")]
    docs = []
    for i in range(200):
        words = [f"v{rng.randrange(30)}" for _ in range(rng.randrange(80))]
        for _ in range(rng.randrange(3)):
            w = ITEM_WORD.findall(rng.choice(items)[1] or "")
            a = rng.randrange(len(w) + 1)
            at = rng.randrange(len(words) + 1)
            words[at:at] = w[a : a + rng.randrange(1, 14)]
        text = rng.choice([" ", ", ", "\n", " - "]).join(words)
        docs.append((i, text.upper() if i % 7 == 0 else text))
    return items, docs


def test_contamination_against_brute_force(spark, odd, none):
    rng = random.Random(5)
    items, docs = passages(rng)
    docs += [(r.doc_id, r.text) for r in odd.collect()] + [(None, docs[3][1]), (3, docs[3][1]), (500, "v1 " * 4000)]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'x' as item_id", "1 as h", "2 as k1").repartition(4)
    b = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "7 as doc_id")
    got = find_contamination(df, b)
    assert as_counter(got.select("doc_id", *HITS).collect()) == brute_hits(docs, items)
    whole = got.where("doc_id = 500").first()
    assert whole.n_hit == 4000 and len(whole.spans) == 3991
    nothing = spark.createDataFrame([], "item_id long, text string")
    assert find_contamination(df, nothing).where("contaminated or n_items > 0").count() == 0
    assert find_contamination(df, nothing).count() == len(docs)
    assert find_contamination(none, b).count() == 0


def test_contamination_without_short_items_and_without_broadcast(spark):
    rng = random.Random(9)
    items, docs = passages(rng)
    items = [(f"id{i}", t) for i, t in items if t and len(t.split()) > 9]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id string, text string")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = find_contamination(df, b).select("doc_id", *HITS)
        assert "BroadcastHashJoin" not in got._jdf.queryExecution().executedPlan().toString()
        assert as_counter(got.collect()) == brute_hits(docs, items)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_contamination_words_of_any_script(spark):
    """The fast patterns find what the definition says, in ASCII texts and in others."""
    texts = ["", "A-z 0_9", "Éa\u00a0B \u0130X", "\x7f\x80 a", "😀A😀-\U0010ffffz", "ſK \u212a k", "Tab\tnew\nline\x00nul", None]
    rows = spark.createDataFrame([(x,) for x in texts], "text string").select("text", _words(F.col("text")).alias("w"), _n_words(F.col("text")).alias("n"))
    for text, words, n in rows.collect():
        lower = (text or "").translate({i: i + 32 for i in range(65, 91)})
        assert words == ITEM_WORD.findall(lower)
        assert n == len(words)


def test_contamination_looks_for_words_once(spark):
    """One search of a text's words for its shingles, in the branch for ASCII or in the other."""
    df = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    listed = text_words(df).select("k1", "n", F.posexplode(F.transform("w", lambda x: F.xxhash64(x))).alias("nth", "h"))
    plan = listed._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 2 and "Filter" not in plan


def test_contamination_stays_native(spark):
    items, docs = passages(random.Random(2))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    plan = find_contamination(df, spark.createDataFrame(items, "item_id long, text string"))._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("InArrow", "InPandas", "Python", "UDF"))


# Filters


def test_swaps_visit_every_order():
    for n in range(1, 6):
        order, seen = list(range(n)), set()
        for level in [None, *adjacent_swaps(n)]:
            if level is not None:
                order[level], order[level + 1] = order[level + 1], order[level]
            seen.add(tuple(order))
        assert seen == set(permutations(range(n))) and len(adjacent_swaps(n)) == len(seen) - 1


def test_diagram_keeps_its_function_under_swaps():
    rng = random.Random(7)
    for _ in range(60):
        n = rng.randrange(1, 6)
        counts = {m: (rng.randrange(3), rng.randrange(2), 0) for m in rng.sample(range(1 << n), rng.randrange(1 << n) + 1)}
        diagram = Diagram(counts, n)
        for level in [None, *adjacent_swaps(n)]:
            if level is not None:
                diagram.swap(level)
            for mask in range(1 << n):
                node = diagram.root
                for f in diagram.order:
                    node = node.failed if mask >> f & 1 else node.passed
                assert node.total == counts.get(mask, (0, 0, 0))
            for level_nodes in diagram.levels:  # equal nodes are shared
                assert len({(id(x.passed), id(x.failed)) for x in level_nodes.values()}) == len(level_nodes)


def brute_masks(docs, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    least, out = {}, Counter()
    for i, text, _ in docs:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    for i, text, part in docs:
        t = text or ""
        w = WORD.findall(t)
        fails = [
            len(w) < 50,
            100 * len(set(w)) < 65 * len(w),
            100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t),
            any(c in "#$%&*|" for c in t),
            i is not None and i > least[t],
        ]
        out[part or "", sum(f << k for k, f in enumerate(fails)), i in good, i in toxic] += 1
    return out


def brute_audit(masks):
    out, shapley = [], Counter()
    parts = {p for p, *_ in masks}
    for part in parts:
        mine = [(m, g, t, n) for (p, m, g, t), n in masks.items() if p == part]
        for order in permutations(range(5)):
            left = mine
            for step, f in enumerate(order, 1):
                bad = [x for x in left if x[0] >> f & 1]
                left = [x for x in left if not x[0] >> f & 1]
                fails = sum(x[3] for x in mine if x[0] >> f & 1)
                removed = sum(x[3] for x in bad)
                only = sum(x[3] for x in mine if x[0] == 1 << f)
                lost = [sum(x[3] for x in bad if x[k]) for k in (1, 2)]
                name = "".join("ABCDE"[k] for k in order)
                out.append((part, name, step, sum(x[3] for x in left), removed, fails - removed, only, *lost, f))
                shapley[part, f] += removed
    return Counter((*row[:-1], shapley[row[0], row[-1]]) for row in out)


def test_audit_against_brute_force(spark, odd, none):
    rng = random.Random(11)
    docs = [(r.doc_id, r.text, r.source) for r in odd.collect()]
    for i in range(300):
        words = [rng.choice(["low", "Cap", "UP", "a#b", "plain", f"w{i}", f"x{rng.randrange(99)}"]) for _ in range(rng.randrange(120))]
        docs.append((i + 20, " ".join(words), rng.choice(["a", "b", "", None])))
    docs += [(x[0] + 1000, x[1], "copy") for x in docs[20:80]] + [(25, docs[3][1], "a"), (None, docs[30][1], "n")] * 2
    docs += [(5000, " ".join(f"w{i}" for i in range(50)), "edge"), (5001, " ".join(["u"] * 65 + [f"w{i}" for i in range(34)]), "edge")]
    labels = [(d[0], rng.choice([0, 1, None]), rng.choice([0, 1])) for d in docs if rng.random() < 0.6] + [(25, 1, 0), (25, 0, 1), (None, 1, 1)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string").selectExpr("*", "0 as mask", "'x' as part").repartition(6)
    told = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").selectExpr("*", "'z' as text")
    masks = brute_masks(docs, labels)
    got = failure_masks(df, told)
    want = Counter()
    for (part, mask, good, toxic), n in masks.items():
        for key, add in (("n", n), ("good", n * good), ("toxic", n * toxic)):
            want[part, mask, key] += add
    assert Counter({(r.part, r["mask"], k): r[k] for r in got.collect() for k in ("n", "good", "toxic")}) == want
    rows = interaction_audit(got, "ABCDE").collect()
    assert as_counter(rows) == brute_audit(masks)
    assert len(rows) == 600 * len({p for p, *_ in masks})
    empty = failure_masks(none, told)
    assert interaction_audit(empty, "ABCDE").count() == 0
    unlabelled = interaction_audit(failure_masks(df, told.limit(0)), "ABCDE")
    assert unlabelled.where("good_lost + toxic_lost > 0").count() == 0 and unlabelled.count() == len(rows)


def test_audit_of_text_ids_and_other_filters(spark):
    docs = spark.createDataFrame([("b", "same", "s"), ("a", "same", "s"), ("c", "same", "t")], "doc_id string, text string, source string")
    labels = spark.createDataFrame([("b", 1, 0)], "doc_id string, quality int, toxic int")
    masks = {(r.part, r["mask"]): (r.n, r.good) for r in failure_masks(docs, labels).collect()}
    assert masks == {("s", 1): (1, 0), ("s", 17): (1, 1), ("t", 17): (1, 0)}
    two = spark.createDataFrame([(None, 3, 2, 1, 0), ("", 1, 5, 0, 0)], "part string, mask int, n long, good long, toxic long")
    rows = {(r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.shapley) for r in interaction_audit(two, "PQ").collect()}
    assert rows == {("PQ", 1): (0, 7, 0, 5, 12), ("PQ", 2): (0, 0, 2, 0, 2), ("QP", 1): (5, 2, 0, 0, 2), ("QP", 2): (0, 5, 2, 5, 12)}
    with pytest.raises(ValueError):
        interaction_audit(two, "")
    assert audit_part("p", {0: (4, 0, 0)}, "A") == [("p", "A", 1, 4, 0, 0, 0, 0, 0, 0)]
