from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelwave.llm.cube_mix import flight, mix_sources, targets
from panelwave.llm.rabitq import neighbours
from panelwave.llm.reply_tree import chosen_paths, escape, format_paths, parse, read_back, render, turns_as_tree, unescape
from panelwave.llm.site_quality import fit_quality, judge
from panelwave.llm.zstd_toxicity import fit_toxicity, score_toxicity

SF = "/root/testdata/sf0.01"


def test_neighbours_against_brute_force(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((300, 16)).round(3)
    x[10:20] = x[10]
    x[20] = -x[0]
    data = [(i, [float(v) for v in row], "t") for i, row in enumerate(x)]
    data += [(300, [0.0] * 16, "t"), (350, None, None), (400, [float("nan")] * 16, None), (None, [1.0] * 16, None)]
    data += [(450, [None] + [1.0] * 15, "t"), (60, data[60][1], "t"), (500, [float("inf")] * 16, "t")]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>, a string")
    got = neighbours(df, every=10, block=64, chunk=8).collect()
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    found = total = 0
    for q in range(0, 300, 10):
        score = unit @ unit[q]
        order = [i for i in np.lexsort((np.arange(300), -score.round(12))) if i != q][:5]
        mine = sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == q)
        assert [r for r, *_ in mine] == [1, 2, 3, 4, 5]
        assert all(abs(s - score[v]) < 1e-9 for _, v, s in mine)
        found += len({v for _, v, _ in mine} & set(order))
        total += 5
    assert len(got) == total and found / total >= 0.97
    assert [r.vec_id for r in got if r.query_id == 10] and {r.vec_id for r in got if r.query_id == 10} == {11, 12, 13, 14, 15}
    assert neighbours(df.limit(0)).count() == 0


def test_template_is_reversible():
    rng = random.Random(3)
    parts = ["</s>", "<s>", "[INST]", "[/INST] ", "\\", " [ANS] ", "[AS]", "x", "\n", "é", "[/ROLE]", " "]
    for _ in range(300):
        turns = [(rng.choice(["user", "assistant", "system", "tool [AS] x"]), "".join(rng.choices(parts, k=rng.randrange(8)))) for _ in range(4)]
        text = "<s>" + "".join(render(r, t)[0] for r, t in turns)
        assert [(r, t) for r, t, _, _ in parse(text)] == turns
        assert all(unescape(escape(t)) == t for _, t in turns)


def test_linear_conversations(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", None), (1, 1, "assistant", "yes </s>"), (2, None, None, "x"), (None, 1, "user", "y")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    messages, texts = turns_as_tree(turns)
    out = {r.conv_id: r for r in read_back(format_paths(chosen_paths(messages), texts)).collect()}
    said = "user\nhi\nassistant\n\nassistant\nyes </s>\n"
    assert set(out) == {1, 2} and out[1].n_turns == 3 and out[1].turns_sha256 == hashlib.sha256(said.encode()).hexdigest()
    assert out[1].loss_chars == 8 and out[2].n_turns == 1
    assert read_back(format_paths(chosen_paths(messages.limit(0)), texts)).count() == 0


def test_best_branches(spark):
    rng = random.Random(8)
    rows, parent = [], {}
    for c in range(5):
        for n in range(40):
            up = None if n == 0 else rng.randrange(max(0, n - 3), n)
            parent[c, n] = up
            rows.append((c, n, up, rng.randrange(100) / 10))
    rows.append((9, 1, 77, 1.0))  # an answer to an unknown message is a root
    df = spark.createDataFrame(rows, "conv_id long, node long, parent long, score double")
    score = {(c, n): s for c, n, _, s in rows}
    got = {}
    for r in chosen_paths(df, per_conversation=2).collect():
        got.setdefault((r.conv_id, r.path), {})[r.depth] = r.node
    for c in range(5):
        leaves = [n for n in range(40) if n not in {parent[c, m] for m in range(40)}]
        ranked = []
        for leaf in leaves:
            path, at = [], leaf
            while at is not None:
                path.append(at)
                at = parent[c, at]
            ranked.append((-sum(score[c, n] for n in path) / len(path), leaf, path[::-1]))
        ranked.sort(key=lambda x: (round(x[0], 9), x[1]))
        for k in (1, 2):
            assert [got[c, k][d] for d in sorted(got[c, k])] == ranked[k - 1][2]
    assert got[9, 1] == {0: 1}
    with pytest.raises(ValueError):
        chosen_paths(spark.createDataFrame([(1, 1, 2, 0.0), (1, 2, 1, 0.0)], df.schema))


def test_targets():
    assert targets([10, 10, 10], [1, 2, 3], 3) == [5.0, 10.0, 15.0]
    assert targets([100, 1, 1], [1, 2, 3], 3) == [96.0, 3.0, 3.0]
    assert targets([], [], 3) == [] and targets([0, 0], [1, 2], 3) == [0.0, 0.0]


def test_flight_keeps_totals():
    rng = np.random.default_rng(3)
    size, p = rng.integers(1, 500, 400).astype(float), rng.random(400)
    q = flight(p, size, rng)
    assert ((q > 0) & (q < 1)).sum() <= 2
    assert abs(q.sum() - p.sum()) < 1e-6 and abs((q - p) @ size) < 1e-4


def test_mixing(spark, odd, none):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    a = mix_sources(docs, chunk=16).toPandas().sort_values("doc_id").reset_index(drop=True)
    b = mix_sources(docs.repartition(7), chunk=16).toPandas().sort_values("doc_id").reset_index(drop=True)
    assert a.equals(b) and (a.taken <= 3 * a["size"]).all() and (a.taken == a.copies * a["size"]).all()
    for _, g in a.groupby(["source_size", "target"]):
        assert abs(g.taken.sum() - g.target.iloc[0]) <= 0.03 * g.target.iloc[0]
    got = mix_sources(odd, carry=("k",)).collect()
    assert sorted(r.k for r in got) == list(range(odd.count())) and all(r.taken <= 3 * r.size for r in got)
    assert mix_sources(none).count() == 0


def test_equal_rows_are_spread_over_chunks(spark, monkeypatch):
    """A third of the rows are equal: no chunk takes more than about its size, and reruns agree."""
    import tempfile

    from panelwave.llm import cube_mix

    noted = f"{tempfile.mkdtemp(dir='/tmp', prefix='run-')}/sizes"
    plain, last = cube_mix.flight, cube_mix.settle_last

    def counted(prob, size, rng):
        with open(noted, "a") as f:
            f.write(f"{len(prob)}\n")
        return plain(prob, size, rng)

    def counted_last(prob, size, rng):
        with open(noted, "a") as f:
            f.write(f"{len(prob)}\n")
        return last(prob, size, rng)

    monkeypatch.setattr(cube_mix, "flight", counted)
    monkeypatch.setattr(cube_mix, "settle_last", counted_last)
    monkeypatch.setattr(cube_mix, "_ALIKE", 64)
    rows = [(None, "same words here", "a")] * 1000 + [(i, "w " * (1 + i % 40), "ab"[i % 2]) for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    a = mix_sources(df.repartition(3), chunk=100).toPandas()
    assert max(map(int, open(noted))) < 180
    b = mix_sources(df.repartition(8), chunk=100).toPandas()
    order = ["doc_id", "size", "source_size", "copies"]
    assert a.sort_values(order).reset_index(drop=True).equals(b.sort_values(order).reset_index(drop=True))
    assert len(a) == 3000 and a.doc_id.isna().sum() == 1000
    for _, g in a.groupby("source_size"):
        assert abs(g.taken.sum() - g.target.iloc[0]) <= 0.01 * g.target.iloc[0]


@pytest.mark.parametrize("kind", ["int", "string"])
def test_models_take_ids_of_other_types(spark, kind):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet").withColumn("doc_id", F.col("doc_id").cast(kind)) for t in ("documents", "labels"))
    model = fit_quality(docs, labels, sample=100)
    rows = judge(docs, model, F.col("source"), F.col("lang"))
    assert dict(rows.dtypes)["doc_id"] == kind and rows.count() == docs.count()
    toxic = score_toxicity(docs, fit_toxicity(docs, labels, sample=60))
    assert dict(toxic.dtypes)["doc_id"] == kind and toxic.count() == docs.count()


def posteriors(rows, prior_least=1.0, prior_most=1000.0):
    """Scores from (host, path, own evidence), by plain sums over all documents."""
    import math

    def strength(groups):
        groups = [(n, r, m) for n, r, m in groups if n > 1]
        if not groups:
            return 10.0
        total = sum(n for n, _, _ in groups)
        between = max((sum(n * (r - m) ** 2 for n, r, m in groups) - sum(m * (1 - m) for _, _, m in groups)) / total, 0.0)
        unit = sum(m * (1 - m) for _, _, m in groups) / len(groups)
        return min(max(unit / between - 1, prior_least), prior_most) if between > 0 else prior_most

    def logit(p):
        p = min(max(p, 1e-6), 1 - 1e-6)
        return math.log(p / (1 - p))

    hosts, paths = {}, {}
    for h, p, own in rows:
        hosts.setdefault(h, []).append(own)
        paths.setdefault((h, p), []).append(own)
    rate = sum(own for *_, own in rows) / len(rows)
    k_host = strength([(len(v), sum(v) / len(v), rate) for v in hosts.values()])
    level = {h: (sum(v) + k_host * rate) / (len(v) + k_host) for h, v in hosts.items()}
    k_path = strength([(len(v), sum(v) / len(v), level[h]) for (h, _), v in paths.items()])
    out = []
    for h, p, own in rows:
        host = (sum(hosts[h]) - own + k_host * rate) / (len(hosts[h]) - 1 + k_host)
        path = (sum(paths[h, p]) - own + k_path * host) / (len(paths[h, p]) - 1 + k_path)
        odds = logit(own) + logit(path) - logit(rate)
        out.append((host, path, 1 / (1 + math.exp(-odds))))
    return out


def test_posteriors_against_plain_sums(spark, odd):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = fit_quality(docs, labels)
    for df in (docs, odd):
        rows = judge(df, model, F.col("source"), F.col("lang"), carry=("source", "lang")).collect()
        want = posteriors([(r.source, r.lang, r.doc_score) for r in rows])
        for r, (host, path, score) in zip(rows, want):
            assert (r.host_rate, r.path_rate, r.score) == pytest.approx((host, path, score), rel=1e-9)
            assert r.kept == (r.score >= 0.5)


def test_toxicity(spark, odd, none):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = fit_toxicity(docs, labels)
    x = score_toxicity(docs, model).join(labels, "doc_id").where("held_out").toPandas()
    bad, good = x[x.toxic == 1].score.to_numpy(), x[x.toxic == 0].score.to_numpy()
    auc = np.mean([((s > good) + 0.5 * (s == good)).mean() for s in bad])
    assert auc > 0.85 and x[x.toxic == 0].predicted.mean() < 0.05
    rows = score_toxicity(odd, model).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    assert score_toxicity(none, model).count() == 0
    blank = score_toxicity(odd, fit_toxicity(odd, labels.limit(0))).collect()
    assert {r.score for r in blank} == {0.5}


def test_quality(spark, odd, none):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = fit_quality(docs, labels)
    x = judge(docs, model, F.col("source"), F.col("lang")).join(labels, "doc_id")
    x = x.where(F.crc32(F.col("doc_id").cast("string")) % 5 == 0).toPandas()
    assert (x.kept == (x.quality == 1)).mean() > 0.95
    rows = judge(odd, model, F.col("source"), F.col("lang"), carry=("k",)).collect()
    assert sorted(r.k for r in rows) == list(range(odd.count())) and all(0 <= r.score <= 1 for r in rows)
    assert judge(none, model, F.col("source"), F.col("lang")).count() == 0


def test_sites_shrink(spark):
    """A large bad host pulls its documents down; a host with one document says nothing."""
    from panelwave.llm.site_quality import QualityModel

    model = QualityModel((0.0, 1.0) + (0.0,) * 8, 0.5)
    data = [(i, "a b c d e f g h" if i % 4 else "a", "big", "p") for i in range(400)]
    data += [(1000 + i, "a b c d e f g h", f"one{i}", "p") for i in range(50)]
    data += [(2000 + i, "a", "bad", "p") for i in range(200)] + [(3000, "a b c d e f g h", "bad", "p")]
    df = spark.createDataFrame(data, "doc_id long, text string, host string, path string")
    x = {r.doc_id: r for r in judge(df, model, F.col("host"), F.col("path")).collect()}
    assert x[3000].score < x[1].score and x[3000].doc_score == x[1].doc_score
    assert abs(x[1000].score - x[1000].doc_score) < 0.02
