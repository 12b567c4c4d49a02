"""Each operator against a brute-force statement of its contract, and on hostile input."""

import hashlib
import itertools
import math
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pandas as pd
import pytest

from pyspark.sql import functions as F

from quotelens.llm import compression, decontamination, katz, line_dedup, mixing, ngram_join, preference, quality_rules, repeat_dedup

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows, extra=False):
    df = spark.createDataFrame([(i, t, "en", "s1" if i is None or i % 3 else None, len(t or "")) for i, t in rows], COLUMNS).repartition(3)
    return df.withColumns({c: F.lit(1) for c in ("node", "chunk", "size", "slot", "key", "region", "score", "home", "root", "runs", "n_lines", "x0", "g_lang", "predicted", "held_out")}) if extra else df


HOSTILE = [(0, None), (1, ""), (2, " \n\t"), (3, "a"), (3, "a"), (4, "same text here again and again"), (5, "same text here again and again"), (None, "same text here again and again"), (None, None), (6, "x" * 5000), (7, ("word " * 3000).strip()), (8, "é́ ü 中文 👍 \x00?".replace("\x00", "")), (9, "line one\n" * 40)]
LABELS = "doc_id long, quality int, toxic int"

OPERATORS = {
    "katz": lambda s, d: katz.katz_scores(d),
    "leaks": lambda s, d: decontamination.decontaminate(d, s.createDataFrame([(1, None), (2, ""), (3, "same text here again and again")], "item_id long, text string")),
    "quality": lambda s, d: compression.quality(d, s.createDataFrame([(3, 1, 0), (4, 0, None), (None, 1, 1)], LABELS)),
    "toxicity": lambda s, d: compression.toxicity(d, s.createDataFrame([], LABELS)),
    "join": lambda s, d: ngram_join.ngram_join(d),
    "mix": lambda s, d: mixing.mix_documents(d),
    "rules": lambda s, d: quality_rules.quality_rules(d),
    "repeats": lambda s, d: repeat_dedup.repeat_dedup(d),
    "lines": lambda s, d: line_dedup.line_dedup(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_hostile_input(spark, name):
    rows = OPERATORS[name](spark, frame(spark, HOSTILE, extra=True)).collect()
    if name == "leaks":
        assert sorted((r["doc_id"] is None, r["doc_id"]) for r in rows) == [(False, 4), (False, 5), (True, None)]
    else:
        assert len(rows) == len(HOSTILE)
        assert Counter(r["doc_id"] for r in rows) == Counter(i for i, _ in HOSTILE)
    assert OPERATORS[name](spark, frame(spark, [])).count() == 0


def test_katz_against_definition(spark):
    rnd = random.Random(3)
    vocab = [f"W{int(rnd.paretovariate(0.7))}" for _ in range(2000)]
    rows = [(i, " ".join(rnd.choice(vocab) for _ in range(rnd.randrange(40)))) for i in range(200)] + [(None, "W1 w2"), (900, None), (5, "w1 w2")]
    for config in (katz.KatzConfig(), katz.KatzConfig(chunk_tokens=300, frequent=0.01)):
        seqs = [(t or "").lower().split() + [None] for _, t in rows]
        train = [s for s, (i, _) in zip(seqs, rows) if not katz.is_held_out(i, config)]
        c1, c2, ch = Counter(), Counter(), Counter()
        for s in train:
            for h, w in zip(["^", *s], s):
                c1[w] += 1
                c2[h, w] += 1
                ch[h] += 1
        of = lambda c: np.array([sum(v == r for v in c.values()) for r in range(config.cut + 3)])
        d1, d2 = katz.discounts(of(c1), config), katz.discounts(of(c2), config)
        cut = lambda c, d: c * (d[c] if c < len(d) else 1.0)
        n, mass = sum(c1.values()), sum(cut(c, d1) for c in c1.values())
        base = n if mass < n else n + 1
        p1 = lambda w: cut(c1[w], d1) / base if c1[w] else 1 - mass / base
        after = defaultdict(list)
        for h, w in c2:
            after[h].append(w)
        weights = {}
        for h, words in after.items():
            kept = sum(cut(c2[h, w], d2) for w in words)
            size = ch[h] if kept < ch[h] else ch[h] + 1
            weights[h] = size, (1 - kept / size) / (1 - sum(map(p1, words)))

        def p(h, w):
            if h not in weights:
                return p1(w)
            return cut(c2[h, w], d2) / weights[h][0] if c2[h, w] else weights[h][1] * p1(w)

        for h in list(weights)[:10]:
            assert sum(p(h, w) for w in c1) + p(h, "unseen") == pytest.approx(1)
        want = sorted((str(i), len(s), sum(c1[w] > 0 for w in s), n, sum(math.log10((c1[w] + 1) / (n + len(c1) + 1)) for w in s), sum(math.log10(p(h, w)) for h, w in zip(["^", *s], s))) for s, (i, _) in zip(seqs, rows))
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
        got = sorted((str(r["doc_id"]), r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in katz.katz_scores(df, config).collect())
        assert [g[:4] for g in got] == [w[:4] for w in want]
        assert np.allclose([g[4:] for g in got], [w[4:] for w in want])


def words(rnd, n, vocab=3000):
    return [f"w{rnd.randrange(vocab)}" for _ in range(n)]


def test_decontamination_finds_copies_and_edits(spark):
    rnd = random.Random(4)
    items = [(i, " ".join(words(rnd, rnd.randrange(15, 50)))) for i in range(12)] + [(50, "two words")]
    rows, leaked = [], set()
    for d in range(120):
        body = words(rnd, 200)
        if d % 4 == 0:
            i, text = items[d % 12]
            part = text.split()
            for _ in range(len(part) // 8 if d % 8 else 0):
                part[rnd.randrange(len(part))] = "edited"
            body[50:50] = [p.upper() + "," for p in part] if d % 3 else part
            leaked.add((d, i))
        rows.append((d, " ".join(body)))
    rows.append((999, "these Two, words. stand"))
    leaked.add((999, 50))
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]): r for r in decontamination.decontaminate(frame(spark, rows), bench).collect()}
    assert set(found) == leaked
    assert all(r["score"] == 1 for (d, _), r in found.items() if d % 8 == 0)
    small = decontamination.LeakConfig(block_words=60)
    assert {(r["doc_id"], r["item_id"]) for r in decontamination.decontaminate(frame(spark, rows), bench, small).collect()} == leaked
    kept = decontamination.leaked_removed(frame(spark, rows), bench)
    assert {r["doc_id"] for r in kept.collect()} == {d for d, _ in rows} - {d for d, _ in leaked}


def test_local_alignment_is_smith_waterman():
    rnd = random.Random(5)
    config = decontamination.LeakConfig()
    pairs = [(np.array([rnd.randrange(6) for _ in range(rnd.randrange(1, 9))], dtype=np.uint64) + np.uint64(2), np.array([rnd.randrange(6) for _ in range(rnd.randrange(1, 14))], dtype=np.uint64) + np.uint64(2)) for _ in range(60)]
    for (a, b), (score, _) in zip(pairs, decontamination.aligned(pairs, config)):
        t = np.zeros((len(a) + 1, len(b) + 1), dtype=int)
        for i in range(len(a)):
            for j in range(len(b)):
                t[i + 1, j + 1] = max(0, t[i, j] + (2 if a[i] == b[j] else -1), t[i, j + 1] - 1, t[i + 1, j] - 1)
        assert score == t.max()


def test_classifiers_on_held_out_rows(spark):
    rnd = random.Random(6)
    rows, labels = [], []
    for d in range(700):
        body = ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randrange(2, 9))) for _ in range(rnd.randrange(40, 160))]
        toxic, bad = d % 6 == 0, d % 5 == 0
        if toxic:
            for _ in range(len(body) // 12 + 2):
                body.insert(rnd.randrange(len(body)), rnd.choice(["vilescum", "moronic", "trashpile"]))
        if bad:
            body = [w.upper() + "!!" for w in body]
        rows.append((d, " ".join(body)))
        labels.append((d, int(not bad), int(toxic)))
    docs, marks = frame(spark, rows), spark.createDataFrame(labels, LABELS)
    for run, name in ((compression.toxicity, "toxic"), (compression.quality, "quality")):
        got = run(docs, marks).join(marks.withColumnRenamed("doc_id", "l"), F.col("doc_id") == F.col("l")).where("held_out").collect()
        assert np.mean([r["predicted"] == r[name] for r in got]) > 0.93
        assert all(0 <= r["score"] <= 1 for r in got)
    kept = {r["doc_id"] for r in compression.rejected_removed(docs, marks).collect()}
    assert len(kept & {d for d in range(700) if d % 5}) > 550 and len(kept & set(range(0, 700, 5))) < 15


@pytest.mark.parametrize("config", [ngram_join.JoinConfig(), ngram_join.JoinConfig(5, 80), ngram_join.JoinConfig(3, 70, few=2, region_items=300, pivots=2), ngram_join.JoinConfig(3, 70, region_rows=8, levels=0), ngram_join.JoinConfig(5, 80, region_rows=6, few=3, pivots=1)])
def test_join_against_all_pairs(spark, config):
    rnd = random.Random(7)
    vocab = [f"w{i}" for i in range(60)]
    base = [[rnd.choice(vocab) for _ in range(n)] for n in (5, 9, 12, 20, 40, 80, 200)]
    rows = []
    for i in range(260):
        w = list(rnd.choice(base))
        for _ in range(rnd.randrange(0, 4)):
            w[rnd.randrange(len(w))] = rnd.choice(vocab)
        rows.append((i, " ".join(w)))
    rows += [(900, None), (901, ""), (902, "a"), (903, "A"), (904, " ")]
    sets = {}
    for i, t in rows:
        w = (t or "").lower().split()
        sets[i] = {tuple(w[j : j + config.k]) for j in range(len(w) - config.k + 1)} if len(w) >= config.k else {tuple(w)} if w else set()
    least = {i: i for i in sets}

    def root(x):
        while least[x] != x:
            x = least[x]
        return x

    for a in sets:
        for b in sets:
            if b < a and sets[a] and 100 * len(sets[a] & sets[b]) >= config.percent * len(sets[a] | sets[b]):
                p, q = root(a), root(b)
                least[max(p, q)] = min(p, q)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.ngram_join(frame(spark, rows), config).collect()}
    assert got == {i: (len(s), root(i)) for i, s in sets.items()}
    kept = {r["doc_id"] for r in ngram_join.near_duplicates_removed(frame(spark, rows), config).collect()}
    assert kept == {i for i in sets if root(i) == i}


@pytest.mark.parametrize("percent", [80, 90])
def test_smallest_sets_of_a_class_have_signatures_of_parts(percent):
    """Sets that may be linked to the next size class are told by parts there, not by single shingles that meet by chance."""
    config, rng = ngram_join.JoinConfig(5, percent), np.random.default_rng(3)
    table = ngram_join.classes(config, 1 << 20)
    sizes = [-(-percent * lo // 100) for lo, *_ in table if 150 < lo < 3000]
    needs = [ngram_join.signatures(np.sort(rng.integers(0, 1 << 62, n).astype(np.uint64)), config, table, np.zeros(0, dtype=np.uint64))[3] for n in sizes for _ in range(20)]
    assert sizes and np.mean(np.array(needs) == 0) < 0.1


@pytest.mark.parametrize("percent", [80, 90])
def test_join_in_rounds_against_all_pairs(spark, percent):
    rnd = random.Random(13)
    base = [words(rnd, n) for n in (12, 16, 30, 33, 90, 110, 140)]
    rows = []
    for i in range(200):
        w = [*rnd.choice(base)][: rnd.choice([None, None, -1, -9])]
        for _ in range(rnd.randrange(0, 3)):
            w[rnd.randrange(len(w))] = rnd.choice(base[2])
        rows.append((i, " ".join(w)))
    sets = {i: {tuple(w[j : j + 3]) for j in range(max(1, len(w) - 2))} for i, t in rows for w in [t.lower().split()]}
    root = {i: i for i in sets}
    for a in sets:
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]) and root[a] != root[b]:
                low, high = sorted((root[a], root[b]))
                root = {i: low if r == high else r for i, r in root.items()}
    config = ngram_join.JoinConfig(3, percent, round_pairs=150, pairs_a_node=0)
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.ngram_join(frame(spark, rows), config).collect()}
    assert got == root and len(set(root.values())) < 190


def test_near_duplicates_are_removed_by_row_not_by_id(spark):
    rnd = random.Random(11)
    alone = [" ".join(words(rnd, 40)) for _ in range(8)]
    base = words(rnd, 100)
    near = " ".join([*base[:99], "other"])
    rows = [(None, alone[0]), (None, alone[1]), (None, None), (None, ""), (1, alone[2]), (1, alone[3]), (2, alone[4]), (None, near)]
    rows += [(3, " ".join(base)), (4, near), (4, alone[5]), (3, alone[6]), (6, alone[7]), (6, alone[7]), (None, alone[7]), (7, " "), (7, None)]
    gone = [(None, near), (4, near), (6, alone[7]), (None, alone[7])]
    for parts in (1, 3, 5):
        got = ngram_join.near_duplicates_removed(frame(spark, rows, extra=True).repartition(parts), ngram_join.JoinConfig(5, 80))
        assert Counter((r["doc_id"], r["text"]) for r in got.collect()) == Counter(rows) - Counter(gone)
        assert got.columns == frame(spark, rows, extra=True).columns
    assert ngram_join.near_duplicates_removed(frame(spark, []), ngram_join.JoinConfig(5, 80)).count() == 0
    assert ngram_join.near_duplicates_removed(frame(spark, HOSTILE), ngram_join.JoinConfig(5, 80)).count() == len(HOSTILE) - 3


def test_mixing(spark):
    rnd = random.Random(8)
    rows = [(i, " ".join(words(rnd, rnd.randrange(0, 30))), "en", rnd.choice([None, "a", "b", "c", "dd"]), 0) for i in range(400)]
    df = spark.createDataFrame(rows, COLUMNS)
    got = mixing.mix_documents(df).toPandas()
    con = duckdb.connect()
    docs = df.toPandas()  # noqa: F841
    want = con.sql(mixing.mixing_sql("docs")).df()
    a, b = (x[["doc_id", "size", "source_size", "target", "taken"]].sort_values("doc_id").reset_index(drop=True) for x in (got, want))
    pd.testing.assert_frame_equal(a.astype(float), b.astype(float))
    per = got.merge(docs[["doc_id", "source"]]).groupby("source", dropna=False)
    assert all(abs(g["taken"].sum() - g["target"].iloc[0]) <= 1 for _, g in per) and (got["taken"] <= 2 * got["size"]).all()


def test_flow_prefers_first_copies_and_shares_overlaps():
    flows = mixing.route([((0,), 100), ((0, 1), 100), ((1,), 50)], [150, 120], 2)
    assert sum(f.get(0, 0) for f in flows) == 150 and sum(f.get(1, 0) for f in flows) == 120
    used = [sum(f.values()) for f in flows]
    assert sum(max(0, u - s) for u, s in zip(used, (100, 100, 50))) == 20
    assert mixing.fill_targets([10, 1000], [5, 1], 1.5 * 1010, 2) == [20.0, 1495.0]


def test_mixing_of_overlapping_sources(spark):
    df = spark.createDataFrame([(i, 10, ["a", "b"] if i % 2 else ["a"]) for i in range(100)], "doc_id long, size long, sources array<string>")
    rows = mixing.mix(df).collect()
    paid = Counter()
    for r in rows:
        assert sum(x["words"] for x in r["allotted"]) == r["taken"] <= 20
        for x in r["allotted"]:
            paid[x["source"]] += x["words"]
    assert sum(paid.values()) == sum(r["taken"] for r in rows) == 1500


def test_quality_counts_against_definition(spark):
    rnd = random.Random(9)
    texts = [None, "", "#a $b\n#a $b\n\n|x|", "a b c d a b c", "é 中文 <x>", "a a a a a", "a b c a b"]
    texts += ["\n".join(" ".join(rnd.choice("abc&é") for _ in range(rnd.randrange(0, 9))) for _ in range(rnd.randrange(1, 9))) for _ in range(200)]
    texts += [" ".join(words(rnd, 120)) for _ in range(80)] + [" ".join(x + "***" for x in words(rnd, 120)) for _ in range(3)]
    got = {r["doc_id"]: r for r in quality_rules.quality_rules(frame(spark, list(enumerate(texts)))).collect()}
    for i, t in enumerate(texts):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        windows = Counter(tuple(w[j : j + 3]) for j in range(len(w) - 2))
        covered = {j + k for j in range(len(w) - 2) if windows[tuple(w[j : j + 3])] > 1 for k in range(3)}
        lines = [x for x in (t or "").split("\n") if x.strip(" \t\n\x0b\x0c\r")]
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(covered))
        assert tuple(got[i][c] for c in quality_rules.COUNTS) == want
        assert got[i]["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])
    clean, spoilt = range(207, 287), range(287, 290)
    assert all(got[i]["kept"] for i in clean) and not any(got[i]["kept"] for i in spoilt)
    assert quality_rules.chi2_quantile(0.95, 6) == pytest.approx(12.5916, abs=1e-3)


def test_least_determinant_against_all_subsets(spark):
    rng, p, n, h = np.random.default_rng(3), len(quality_rules.FEATURES), 14, 11
    rows, want = [], {}
    floor = np.diag(np.square(quality_rules.FLOORS))
    for g in range(12):
        x = rng.normal(size=(n, 2)) @ rng.normal(size=(2, p)) * 4 + rng.normal(size=(n, p)) * 0.3
        x[:3] += rng.normal(size=p) * 12
        subsets = np.array(list(itertools.combinations(range(n), h)))
        core = x[subsets]
        covs = np.einsum("ski,skj->sij", c := core - core.mean(1, keepdims=True), c) / h + floor
        k = int(np.linalg.slogdet(covs)[1].argmin())
        d = x - core[k].mean(0)
        d2 = np.einsum("ni,ij,nj->n", d, np.linalg.inv(covs[k]), d)
        mid = np.sort(d2)[(n + 1) // 2 - 1]
        want[g] = d2 / max(1.0, mid / quality_rules.chi2_quantile(0.5, p))
        rows += [(g * 100 + i, "en", f"s{g}", False, *map(float, x[i])) for i in range(n)]
    ddl = "doc_id long, lang string, source string, base_failed boolean, " + ", ".join(f"x{i} double" for i in range(p))
    found = quality_rules.outliers(spark.createDataFrame(rows, ddl), quality_rules.OutlierConfig(min_rows=10)).select("doc_id", "robust_d2").collect()
    got = {r["doc_id"]: r["robust_d2"] for r in found}
    same = [g for g in want if np.allclose([got[g * 100 + i] for i in range(n)], want[g])]
    assert len(same) >= 9, same  # one start alone finds 7


@pytest.mark.parametrize("config", [repeat_dedup.RepeatConfig(), repeat_dedup.RepeatConfig(segment=150, hold=1000), repeat_dedup.RepeatConfig(filter_bits=8)])
def test_repeats_against_definition(spark, config):
    rnd = random.Random(2)
    text = lambda n: " ".join("".join(rnd.choice("abcdeé") for _ in range(rnd.randrange(1, 7))) for _ in range(n))
    parts = [text(rnd.randrange(10, 60)) for _ in range(12)] + ["ab" * 200, "x" * 500]
    rows = [(i, " ".join(rnd.choice(parts)[rnd.randrange(0, 40) : rnd.randrange(50, 400)] if rnd.random() < 0.4 else text(rnd.randrange(1, 40)) for _ in range(rnd.randrange(1, 8)))) for i in range(200)]
    rows += [(500, None), (501, ""), (502, "x" * 99)]
    seen, want = set(), {}
    for i, t in sorted(rows):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 99):
            if b[p : p + 100] in seen:
                gone[p : p + 100] = b"\1" * 100
            seen.add(b[p : p + 100])
        rest = bytes(c for c, g in zip(b, gone) if not g)
        want[i] = (len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(rest).hexdigest())
    got = {r[0]: tuple(r)[1:] for r in repeat_dedup.repeat_dedup(frame(spark, rows), config).collect()}
    assert got == want


def test_lines_and_pairs_against_sql(spark):
    rnd = random.Random(10)
    pool = [" ".join(words(rnd, n)) for n in (3, 3, 4, 6, 20, 30, 55, 60)] + ["", " "]
    rows = [(i, "\n".join(rnd.choice(pool) if rnd.random() < 0.7 else " ".join(words(rnd, 5)) for _ in range(rnd.randrange(1, 12)))) for i in range(150)]
    turns = [(c, t, "user" if t % 2 == 0 else "assistant", rnd.choice(["hi", "yes", "no <|x|>"])) for c in range(90) for t in range(rnd.randrange(1, 5))]
    documents = pd.DataFrame(rows, columns=["doc_id", "text"])  # noqa: F841
    conversations = pd.DataFrame(turns, columns=["conv_id", "turn", "role", "text"])  # noqa: F841
    con = duckdb.connect()
    got = line_dedup.line_dedup(frame(spark, rows)).toPandas()
    got["kept_sha256"] = [hashlib.sha256((t or "").encode()).hexdigest() for t in got["text"]]
    want = con.sql(line_dedup.line_dedup_sql()).df()
    a, b = (x[["doc_id", "n_lines", "n_removed", "n_runs", "kept_sha256"]].sort_values("doc_id").reset_index(drop=True) for x in (got, want))
    assert a.astype(str).equals(b.astype(str)) and got["n_removed"].sum() > 0
    assert (got["n_chars"] == [len(t) for t in got["text"]]).all()
    df = preference.preference_pairs(spark.createDataFrame(turns + turns[:5], "conv_id long, turn long, role string, text string"))
    got = df.withColumns({c: preference.spans_text(c) for c in ("chosen_mask", "rejected_mask")}).toPandas()
    want = con.sql(preference.preference_sql()).df()
    a, b = (x[sorted(x.columns)].sort_values("chosen_id").reset_index(drop=True) for x in (got, want))
    for c in a.columns:
        assert [None if pd.isna(x) else str(x).removesuffix(".0") for x in a[c]] == [None if pd.isna(x) else str(x).removesuffix(".0") for x in b[c]]
    row = df.where("rejected_id is not null and size(chosen_mask) > 0").first()
    for s in row["chosen_mask"]:
        assert row["chosen"][: s["lo"]].endswith("<|assistant|>\n") and row["chosen"][s["hi"] :].startswith("\n<|end|>")


def test_preference_edge_cases(spark):
    rows = [(None, 0, None, None), (1, 0, "user", "a"), (2, 0, "user", "a"), (2, 1, "assistant", "b"), (2, 1, "assistant", "b"), (3, None, "user", "z")]
    got = {r["chosen_id"]: r for r in preference.preference_pairs(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert len(got) == 3 and got[1]["rejected_id"] == 2 and got[1]["chosen"] == "" and got[1]["n_prompt_turns"] == 1
    assert got[3]["rejected"] is None and got[None]["n_prompt_turns"] == 0
    assert preference.preference_pairs(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
