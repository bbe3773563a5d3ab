from __future__ import annotations

import hashlib
import random
import re
import tempfile
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from panelwave.llm.blob_ledger import BASE, RULES, Rule, distinct_blobs, find_secrets, redacted, scan_blobs, summary
from panelwave.llm.complement_pack import ChunkTokenizer, _distinct, pack, plan
from panelwave.llm.hyperminhash import estimate, near_duplicates, registers, shingles
from panelwave.llm.line_clean import clean_lines
from panelwave.llm.seed_extend import remove_repeats
from panelwave.llm.wordscan import Words
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def docs_of(odd):
    return [(r.doc_id, r.text or "") for r in odd.collect()]


def as_counter(rows):
    return Counter(tuple(r) for r in rows)


def test_words_match_a_pattern(odd):
    texts = [t for _, t in docs_of(odd)]
    w = Words(pa.array(texts))
    got = [w.data[a:b].tobytes().decode() for a, b in zip(w.start, w.end)]
    assert got == [x for t in texts for x in WORD.findall(t)]
    value = {}
    for word, h in zip(got, w.hash.tolist()):
        assert value.setdefault(word, h) == h
    assert len(set(value.values())) == len(value)


def test_line_cleaning_statistics(odd, none):
    want = []
    for i, text in docs_of(odd):
        w, seen, dup = WORD.findall(text), set(), 0
        for line in text.split("\n"):
            if WORD.search(line):
                dup += line in seen
                seen.add(line)
        runs = Counter(tuple(w[j : j + 8]) for j in range(len(w) - 7))
        cover = {j + s for j in range(len(w) - 7) if runs[tuple(w[j : j + 8])] > 1 for s in range(8)}
        failed = len(w) < 20 or 100 * len(cover) > 30 * len(w)
        want.append((i, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(cover), failed))
    got = clean_lines(odd).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"
    )
    assert as_counter(got.collect()) == Counter(want)
    assert clean_lines(none).count() == 0


def test_line_rules(spark):
    good = "This is a plain sentence with quite a few ordinary words in it, and it ends well."
    menu = "Home | News | Sports | Weather | Shop | Help | About"
    texts = [
        "\n".join([good, menu, good[::-1] + ".", "Please accept every cookie here to go on reading now."]),
        "\n".join([menu + str(i) for i in range(9)] + ["one good line of a few words."]),
    ]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    a, b = clean_lines(df).orderBy("doc_id").collect()
    assert a.kept and a.clean_text == good + "\n" + good[::-1] + "." and a.n_lines_failed == 2
    assert not b.kept and b.lost_share > 0.5
    with pytest.raises(ValueError):
        clean_lines(df.withColumn("kept", F.lit(1)), keep=("kept",))


def test_stock_phrases_are_whole_words_and_much_of_their_line(spark):
    prose = "The team will design in a way that keeps the catalog in order, and the blog in question says as much in every single part of it."
    biscuit = "She took one more cookie from the plate, and the long evening went on while nobody in the old house said a word about it."
    hindi = "यह एक सरल वाक्य है जिसमें कई शब्द हैं और यह अंत में समाप्त होता है। " * 8
    chinese = "这 是 一个 简单 的 句子 有 很多 词 它 在 这里 结束 。 " * 8
    menu = ["Home", "News", "Sports today", "Weather", "Shop", "About us"]
    poem = ["Rain falls.", "Night comes;", "We wait:", "It stops."] * 3
    texts = [prose, biscuit, hindi, chinese, "\n".join([prose, *menu, "Please sign in", biscuit]), "\n".join([prose, *poem])]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    rows = clean_lines(df).orderBy("doc_id").collect()
    assert [r.n_lines_failed for r in rows[:4]] == [0, 0, 0, 0] and all(r.lost_share == 0 for r in rows[:4])
    assert all(r.kept for r in rows[:2])
    assert rows[4].clean_text == prose + "\n" + biscuit and rows[4].n_lines_failed == 7
    assert rows[5].n_lines_failed == 8  # the repeats of the poem's lines only


def brute_repeats(docs, span):
    starts = Counter(tuple(w[i : i + span]) for w in docs for i in range(len(w) - span + 1))
    out = []
    for w in docs:
        gone = {i + j for i in range(len(w) - span + 1) if starts[tuple(w[i : i + span])] > 1 for j in range(span)}
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def test_repeats_against_brute_force(odd, none, spark):
    rng = random.Random(4)
    texts = docs_of(odd)
    for i in range(60):  # near copies with edits, shared passages, a text that repeats itself
        words = [f"q{j}" for j in range(120)]
        for _ in range(rng.randrange(4)):
            words[rng.randrange(120)] = f"e{rng.randrange(9)}"
        texts.append((100 + i, " ".join(words[rng.randrange(40) : 60 + rng.randrange(60)] * rng.randrange(1, 3))))
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(5)
    want = Counter((i, *x) for (i, _), x in zip(texts, brute_repeats([WORD.findall(t) for _, t in texts], 35)))
    got = remove_repeats(df).select("doc_id", "n_words", "n_removed", "kept_sha256")
    assert as_counter(got.collect()) == want
    assert remove_repeats(none).count() == 0
    for kind in ("int", "string"):  # an id keeps its type
        ids = df.withColumn("doc_id", F.col("doc_id").cast(kind))
        typed = remove_repeats(ids).select("doc_id", "n_words", "n_removed", "kept_sha256")
        assert dict(typed.dtypes)["doc_id"] == kind
        assert as_counter(typed.withColumn("doc_id", F.col("doc_id").cast("long")).collect()) == want


def test_repeats_among_rows_without_own_ids(spark, monkeypatch):
    """Null and repeated ids: right results, and no list of places longer than one text's own."""
    from panelwave.llm import seed_extend

    common, rng = [f"c{j}" for j in range(80)], random.Random(6)
    texts = []
    for i in range(90):
        words = [f"o{i}x{j}" for j in range(20)] + common[rng.randrange(30) :] + [f"z{i}"]
        texts.append(((None, 5, 1000 + i)[i % 3], " ".join(words)))
    texts += [(None, texts[0][1])] * 6 + [(5, texts[1][1])] * 6
    sizes = f"{tempfile.mkdtemp(dir='/tmp', prefix='run-')}/sizes"
    places = seed_extend._places

    def noted(part, column, w, span):
        with open(sizes, "a") as f:
            f.writelines(f"{len(x)} {n}\n" for x, n in zip(part.column(column).to_pylist(), w.count.tolist()) if x)
        return places(part, column, w, span)

    monkeypatch.setattr(seed_extend, "_places", noted)
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(5)
    want = Counter((i, *x) for (i, _), x in zip(texts, brute_repeats([WORD.findall(t) for _, t in texts], 35)))
    got = seed_extend.remove_repeats(df).select("doc_id", "n_words", "n_removed", "kept_sha256")
    assert as_counter(got.collect()) == want
    listed = [tuple(map(int, x.split())) for x in open(sizes)]
    assert listed and all(n <= words for n, words in listed)


def brute_groups(docs, percent=85):
    sets = []
    for _, text in docs:
        w = WORD.findall(text.translate(LOWER))
        sets.append({tuple(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) > 2 else {tuple(w)} if w else set())
    label = list(range(len(docs)))
    changed = True
    linked = [
        (i, j)
        for i in range(len(sets))
        for j in range(i)
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])
    ]
    while changed:
        changed = False
        for i, j in linked:
            low = min(label[i], label[j])
            changed |= label[i] != low or label[j] != low
            label[i] = label[j] = low
    least = {}
    for (i, _), l in zip(docs, label):
        if i is not None:
            least[l] = min(least.get(l, i), i)
    return Counter((i, len(s), least.get(l), i == least.get(l)) for (i, _), s, l in zip(docs, sets, label))


def test_near_duplicates_against_brute_force(odd, none, spark):
    rng = random.Random(9)
    docs = docs_of(odd)
    for g in range(6):  # groups of near copies around the limit, long and very short
        base = [f"g{g}x{j}" for j in range(rng.choice((7, 12, 60, 150)))]
        for i in range(25):
            w = list(base)
            for _ in range(rng.randrange(4)):
                w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
            docs.append((1000 + 100 * g + i, " ".join(w)))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    got = as_counter(near_duplicates(df, block_bytes=4000).collect())
    assert got == brute_groups(docs)
    assert near_duplicates(none).count() == 0


def test_near_duplicates_among_rows_without_own_ids(spark, monkeypatch):
    """Null and shared ids: right groups, and each text is read as often as its row, not as often as
    rows of the same id."""
    from panelwave.llm import hyperminhash

    texts = []
    for i in range(400):
        words = [f"n{i // 2}x{j}" for j in range(40)] + [f"t{i % 2}"]
        texts.append(((None, 7)[i // 200], " ".join(words)))
    noted = f"{tempfile.mkdtemp(dir='/tmp', prefix='run-')}/rows"
    plain = hyperminhash.shingles

    def counted(column, *more):
        with open(noted, "a") as f:
            f.write(f"{len(column)}\n")
        return plain(column, *more)

    monkeypatch.setattr(hyperminhash, "shingles", counted)
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    rows = near_duplicates(df.withColumn("t", F.col("text")), carry=("t",), with_label=True).collect()
    group = {}
    for r in rows:
        group.setdefault(r.label, set()).add(r.t.rsplit(" ", 1)[0])
    assert len(rows) == 400 and len(group) == 200 and all(len(g) == 1 for g in group.values())
    assert sum(map(int, open(noted))) <= 2 * 400


def test_register_estimate_is_unbiased():
    errors = []
    for trial in range(60):
        words = [f"{trial}a{i}" for i in range(900)]
        other = words[:800] + [f"{trial}b{i}" for i in range(100)]
        row, value, at = shingles(pa.array([" ".join(words), " ".join(other)]), 1)
        r = registers(row, value, 2)
        errors.append(estimate(r[:1], r[1:])[0] - 800 / 1000)
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.06


def test_chunks_give_the_tokenizer_s_ids(odd):
    path = public_tokenizers.path("byte_bpe_50k.json")
    plain = Tokenizer.from_file(path)
    plain.encode_special_tokens = True
    texts = [t for _, t in docs_of(odd)] + ["it's we'll  two  spaces\n\n a  b  c", "　x y", " lead", "tail ", "éa b éé c\u0085 d"]
    own = ChunkTokenizer(path, cached=50)
    for _ in range(2):
        ids, at = own.encode(pa.array(texts))
        for i, t in enumerate(texts):
            assert ids[at[i] : at[i + 1]].tolist() == plain.encode(t, add_special_tokens=False).ids + [0]


def test_packing(odd, none):
    path = public_tokenizers.path("byte_bpe_50k.json")
    plain = Tokenizer.from_file(path)
    plain.encode_special_tokens = True
    rows = pack(odd, path, limit=64, with_ids=True).collect()
    texts = Counter((i, tuple(plain.encode(t, add_special_tokens=False).ids + [0])) for i, t in docs_of(odd))
    by_sequence = {}
    for r in rows:
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length <= 64
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by_sequence.values():
        places.sort()
        assert [o for o, _ in places] == np.append(0, np.cumsum([n for _, n in places])[:-1]).tolist()
        assert sum(n for _, n in places) <= 64
    assert sum(r.length for r in rows) == sum(len(ids) * n for (_, ids), n in texts.items())
    assert sum(r.piece == 0 for r in rows) == odd.count()
    whole = [r for r in rows if r.doc_id == 7]
    whole.sort(key=lambda r: r.piece)
    assert (7, tuple(x for r in whole for x in r.ids)) in texts and all(r.length == 64 for r in whole[1:])
    assert pack(none, path).count() == 0


def test_special_strings_are_the_tokenizer_s_own(spark, tmp_path):
    """The query's ids are those of the untouched tokenizer, chunk borders beside a special string included."""
    import corpus_pipeline
    from panelwave.llm.queries import op3_exact_complement_packing

    path, e = public_tokenizers.path("byte_bpe_50k.json"), "<|endoftext|>"
    plain = Tokenizer.from_file(path)
    assert plain.encode(f"a {e} b", add_special_tokens=False).ids == [64, 220, 50256, 275]
    texts = [f"a {e} b", e, f"{e} b", f"a {e}", f"a{e}b c", f"a  {e}  b", f"x {e}{e} y {e}'s it's", f" {e} ", f"é {e}\n{e} 漢 {e}é", "<| endoftext|>"]
    texts.append(" ".join(f"w{i} {e if i % 3 else 'v' + e + '.'}" for i in range(900)))
    own = ChunkTokenizer(path, cached=50, special_as_text=False)
    want = [plain.encode(t, add_special_tokens=False).ids + [0] for t in texts]
    for _ in range(2):
        ids, at = own.encode(pa.array(texts))
        assert [ids[at[i] : at[i + 1]].tolist() for i in range(len(texts))] == want
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for rows in (op3_exact_complement_packing(spark, str(tmp_path)), corpus_pipeline.best_fit_packing(spark, docs, "")):
        got = {(r.doc_id, r.start): (r.length, r.ids_crc32) for r in rows.collect()}
        for i, x in enumerate(want):
            cuts = [0, *range(len(x) % 2048 or 2048, len(x), 2048), len(x)]
            for a, b in zip(cuts, cuts[1:]):
                assert got.pop((i, a)) == (b - a, zlib.crc32(np.array(x[a:b], "<u4").tobytes()))
        assert not got


def test_plan_uses_exact_complements():
    rng = np.random.default_rng(1)
    counts = Counter(rng.integers(1, 65, 5000).tolist())
    out = plan(counts, 64)
    used = Counter()
    for pattern, n in out:
        assert n > 0 and sum(pattern) <= 64
        for x in pattern:
            used[x] += n
    assert used == counts
    total = sum(k * n for k, n in counts.items())
    assert sum(n for _, n in out) <= 1.01 * total / 64
    assert sum(n for _, n in plan({40: 3}, 64)) == 3 and plan({}, 64) == []


def brute_secrets(text):
    out = []
    for i, r in enumerate(BASE):
        pattern = {"access": r"AKIA[A-Z0-9]+", "hex": r"[0-9a-f]+"}.get(r.kind, r.pattern)
        least = {"access": 20, "hex": 24}.get(r.kind, r.least)
        for m in re.finditer(pattern, text):
            if len(m.group(r.group)) >= least:
                out.append((m.start(), i, m.end(), r.kind))
    return sorted(out)


def test_secrets(odd, none):
    want = Counter()
    for i, text in docs_of(odd):
        found = brute_secrets(text)
        listed = ",".join(f"{k}:{a}:{b}" for a, _, b, k in found)
        n = Counter(k for *_, k in found)
        want[i, n["assign"], n["access"], n["hex"], hashlib.sha256(listed.encode()).hexdigest()] += 1
    findings, entries = find_secrets(odd)
    got = summary(findings).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256")
    assert as_counter(got.collect()) == want
    assert summary(find_secrets(none)[0]).count() == 0
    again, fresh = find_secrets(odd, ledger=entries)
    assert fresh.count() == 0 and as_counter(summary(again).collect()) == as_counter(summary(findings).collect())
    changed = (*RULES[:2], Rule("hex", r"[0-9a-f]{40,}", version=2))
    newer, fresh = find_secrets(odd, ledger=entries, rules=changed)
    assert {r.rule for r in fresh.select("rule").distinct().collect()} == {"hex:2"}
    assert summary(newer).agg(F.sum("n_hex")).first()[0] == 0


def test_equal_rows_are_spread_over_ranking_tasks(spark, monkeypatch, tmp_path):
    """A third of the rows are equal: their pieces share a length but no task, and none is lost."""
    from panelwave.llm import complement_pack

    kept, plain = {}, complement_pack.stored
    monkeypatch.setattr(complement_pack, "stored", lambda df, name: kept.setdefault(name, plain(df, name)))
    rows = [(None, "equal words")] * 1000 + [(i, f"text {i} " * (i % 7)) for i in range(2000)]
    out = pack(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), public_tokenizers.path("byte_bpe_50k.json"))
    assert out.count() == 3000 and out.where("doc_id is null").count() == 1000
    places = out.select("sequence_id", "offset", "length").orderBy("sequence_id", "offset").collect()
    at = {}
    for r in places:
        assert at.get(r.sequence_id, 0) == r.offset
        at[r.sequence_id] = r.offset + r.length
    assert max(at.values()) <= 2048
    salted = kept["pieces"].groupBy("length", F.pmod("spread", F.lit(8))).count()
    assert salted.agg(F.max("count")).first()[0] < 1000


def test_a_pair_of_blob_and_rule_is_scanned_once(odd, spark):
    """First the base rules, then all of them, then more rows: the ledger gets every pair once, and
    one pass over the texts opens all rules."""
    texts = {text for _, text in docs_of(odd)}
    blobs = distinct_blobs(odd)
    assert {r.text for r in blobs.collect()} == texts and blobs.count() == len(texts)
    _, base = find_secrets(odd, rules=BASE, blobs=blobs)
    findings, more = find_secrets(odd, base, blobs=blobs)
    assert base.count() == 3 * len(texts) and more.count() == (len(RULES) - 3) * len(texts)
    assert as_counter(summary(findings).collect()) == as_counter(summary(find_secrets(odd)[0]).collect())
    new = spark.createDataFrame([(900, "token: abcdef99"), (901, docs_of(odd)[0][1])], "doc_id long, text string")
    both = odd.select("doc_id", "text").unionByName(new)
    _, last = find_secrets(both, base.unionByName(more))
    assert last.count() == len(RULES) and base.unionByName(more).unionByName(last).distinct().count() == len(RULES) * (len(texts) + 1)
    plan = scan_blobs(distinct_blobs(new).withColumn("known", F.array(F.lit("hex:1"))))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan ExistingRDD") == 1 and "Union" not in plan and "InArrow" not in plan


def test_redaction(odd):
    found, _ = find_secrets(odd.where("doc_id = 12"))
    text = odd.where("doc_id = 12").join(found, "doc_id").select(redacted(F.col("text"), F.col("found"))).first()[0]
    assert text == "[secret], [secret] and [secret]"


def test_distinct_chunks_and_learned_ids():
    """Distinct values as numpy gives them; ids learned in groups are those of each text by itself."""
    rng = np.random.default_rng(3)
    for n in (1, 7, 5000):
        values = rng.integers(0, 2**64, max(n // 3, 1), np.uint64)[rng.integers(0, max(n // 3, 1), n)]
        got, want = _distinct(values), np.unique(values, return_index=True, return_inverse=True)
        assert all(np.array_equal(a, b) for a, b in zip(got, want))
    texts = ["", " lead", "two  gaps", "漢字 é x", "tab\tend ", "a<|endoftext|>b c", *[f"w{i} v{i * i} z" for i in range(900)]]
    one = ChunkTokenizer(public_tokenizers.path("byte_bpe_50k.json"))
    ids, offset = one.encode(pa.array(texts))
    for i, text in enumerate(texts):
        assert ids[offset[i] : offset[i + 1]].tolist() == [*one.tokenizer.encode(text, add_special_tokens=False).ids, 0]
