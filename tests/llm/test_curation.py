"""Manifest, resampling and quality rules against plain Python, with nulls, empty, long, repeated and odd rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from vecloom.llm import merkle, resample, rules
from vecloom.llm.queries import op11_merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, leaf string, place long, tree string, bucket int, stratum string"
EXTRA = ("x", 1, "y", 2, "z")


def words(seed: int, n: int, of: int = 300) -> str:
    draw = random.Random(seed)
    return " ".join(f"{draw.choice(['w', 'W', 'é', '😀'])}{draw.randrange(of)}" for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    found = [
        (None, "No id", "en", "a", 5), (None, "No id", "en", "a", 5), (None, None, None, None, None), (1, None, "en", None, 0), (2, "", None, "", 0),
        (3, "Ünïcode ÀB c", "de", "a|1", 12), (4, "x", "de", "a", None), (4, "x", "de", "a", None), (4, "X", "de", "a", 1), (5, words(9, 20_000), "en", "long", 1),
        (6, "Lone Group", "fr", "only", 10), (7, "Two", "fr", "pair", 1), (8, "twO", "fr", "pair", 1), (9, "\x00 a\x00b\n\n a", "en", "a", 3),
    ]
    found += [(100 + i, words(i, 1 + i % 60), ["en", "de", None][i % 3], "hot", i) for i in range(300)]
    found += [(1000 + i, words(i % 3, 40), "en", f"s{i:02d}", i) for i in range(40)]
    return [(*row, *EXTRA) for row in found]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(7)


def h(*inputs: str) -> str:
    return hashlib.sha256("".join(inputs).encode()).hexdigest()


def leaf_of(values) -> str:
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def brute_climb(rows):
    """(doc_id, leaf, subroot, root, proof, folded) of every row, by walking the trees."""
    trees = defaultdict(list)
    for doc_id, text, lang, source, n_chars, *_ in rows:
        changed = text
        if doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0 and text is not None:
            changed = re.sub("[A-Z]", lambda m: m[0].lower(), text)
        trees[source].append((doc_id, leaf_of((doc_id, source, lang, n_chars, text)), leaf_of((doc_id, source, lang, n_chars, changed))))
    order = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))

    def level_up(nodes):
        return [h(*nodes[i : i + 16]) for i in range(0, len(nodes), 16)]

    def path(nodes, at):
        """The siblings' sides on the way up, and the end."""
        steps = []
        while len(nodes) > 1:
            run = nodes[at // 16 * 16 : at // 16 * 16 + 16]
            steps.append((run[: at % 16], run[at % 16 + 1 :]))
            nodes, at = level_up(nodes), at // 16
        return steps, nodes[0]

    leaves = {s: sorted(trees[s], key=lambda r: (r[0] is not None, r[0] or 0, r[1])) for s in order}
    subroots = [path([x[1] for x in leaves[s]], 0)[1] for s in order]
    found = []
    for place, s in enumerate(order):
        top, root = path(subroots, place)
        for at, (doc_id, leaf, changed) in enumerate(leaves[s]):
            own, _ = path([x[1] for x in leaves[s]], at)
            folded = changed
            for left, right in own + top:
                folded = h(*left, folded, *right)
            found.append((doc_id, leaf, subroots[place], root, h(*[x for left, right in own + top for x in left + right]), folded, folded == root))
    return found


def climbed(docs):
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    changed = merkle.leaf_digest(*[lowered if c == "text" else F.col(c) for c in merkle.FIELDS])
    marked = F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, changed)
    return merkle.climb(merkle.build_manifest(docs, found=marked))


def test_manifest_against_brute_force(spark, docs, rows, many_chunks):
    got = climbed(docs)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert Counter(map(tuple, got.collect())) == Counter(brute_climb(rows))
    assert spark.conf.get("spark.sql.cteRecursionRowLimit") != "-1"


@pytest.mark.parametrize("n", [0, 1, 2, 16, 17, 257])
def test_manifest_sizes_of_one_group(spark, n):
    rows = [(i, f"T{i}", "en", "one", i, *EXTRA) for i in range(n)]
    got = climbed(spark.createDataFrame(rows, SCHEMA)).collect()
    assert Counter(map(tuple, got)) == Counter(brute_climb(rows) if rows else [])


def test_manifest_finds_every_changed_row(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = op11_merkle(spark, "/root/testdata/sf0.001")
    changed = docs.where("pmod(crc32(cast(doc_id as string)), 5) = 0 and text rlike '[A-Z]'")
    assert {r[0] for r in got.where("not verified").select("doc_id").collect()} == {r[0] for r in changed.select("doc_id").collect()}


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def runs_of(text, n=2):
    found = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return found, [" ".join(found[i : i + k]) for k in range(1, n + 1) for i in range(len(found) - k + 1)]


def brute_resample(rows, target, n=2, buckets=10_000, percent=25):
    def counts(texts):
        return Counter(zlib.crc32(run.encode()) % buckets for text in texts for run in runs_of(text, n)[1])

    s, t = counts(r[1] for r in rows), counts(target)
    all_s, all_t = sum(s.values()), sum(t.values())

    def gain(b):
        return math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets))))

    scored = []
    for doc_id, text, *_ in rows:
        found, runs = runs_of(text, n)
        weight = sum(gain(zlib.crc32(r.encode()) % buckets) for r in runs) // len(runs) if runs else 0
        noise = int(h(f"7:{'' if doc_id is None else doc_id}")[:8], 16)
        scored.append((doc_id, len(runs), weight, weight + math.floor(-1000 * math.log(-math.log((noise + 0.5) / 4294967296))), len(found)))
    eligible = sorted((r for r in scored if r[4] >= 20), key=lambda r: (-r[3], r[0] is not None, r[0] or 0, r[1]))
    drawn = percent * len(eligible) // 100
    return [(*r[:4], i + 1 if i < drawn else None) for i, r in enumerate(eligible)] + [(*r[:4], None) for r in scored if r[4] < 20]


@pytest.mark.parametrize("n, buckets", [(2, 10_000), (1, 7), (3, 64)])
def test_resample_against_brute_force(spark, docs, rows, monkeypatch, many_chunks, n, buckets):
    # Small blocks, so that runs cross their borders.  Workers are forked copies, so the border is tested here in the driver.
    target = [words(1, 50), None, "", "Lone é"]
    asked = spark.createDataFrame([(t,) for t in target], "text string")
    got = resample.importance_resample(docs, asked, n=n, buckets=buckets)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert Counter(map(tuple, got.collect())) == Counter(brute_resample(rows, target, n, buckets))


@pytest.mark.parametrize("n", [1, 2, 3, 4])
@pytest.mark.parametrize("block", [1, 2, 3, 1000])
def test_runs_across_blocks(monkeypatch, n, block):
    monkeypatch.setattr(resample, "BLOCK", block)
    texts = ["a b c d e", "", "F", "g " + "h" * 200 + " i " + "é" * 90, "\x00j\x00k", "l", "m n"]
    found = Counter()
    for doc, bucket, length in resample.buckets_of([t.encode() for t in texts], n, 1 << 31):
        found.update(zip(doc.tolist(), bucket.tolist(), length.tolist()))
    wanted = Counter((i, zlib.crc32(r.encode()) % (1 << 31), len(r.split(" "))) for i, t in enumerate(texts) for r in runs_of(t, n)[1])
    assert found == wanted


def test_resample_edges(spark, docs):
    empty = docs.where("false")
    assert resample.importance_resample(empty, docs.select("text")).count() == 0
    alone = resample.importance_resample(docs, empty, keep=["doc_id", "text", "leaf"])
    assert alone.columns[:3] == ["doc_id", "text", "leaf"] and alone.count() == docs.count()
    with pytest.raises(ValueError):
        resample.importance_resample(docs.withColumn("rank", F.lit(1)), empty, keep=["doc_id", "rank"])
    with pytest.raises(ValueError):
        resample.importance_resample(docs, empty, keep=["text"])


def brute_statistics(text):
    text = text or ""
    found = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(found[i : i + 5]) for i in range(len(found) - 4)]
    seen, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if seen[w] > 1:
            covered.update(range(i, i + 5))
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (
        len(found), sum(map(len, found)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), len(lines),
        sum(1 for c in text if c.isupper() and c.isalpha()),
    )


TEXTS = [
    None, "", " ", "\n\n", "a", "a b c d", "a b c d e", "a b c d e a b c d e", "a a a a a a", "a a a a a a a", "x a b c d e y a b c d e z", " lead and trail \n",
    "l\nl\nl \nl\n\n \n \n", "tab\tvt\x0bff\x0ccr\r\nl", "#*$%&|<> é😀 ÀÉ", "a b c d e f", "A b C\nA b C\nA b C\nA b C", words(3, 20_000, 40), words(4, 4000) * 2,
]


def test_statistics_against_brute_force(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    got = {r["doc_id"]: tuple(r[c] for c in rules.STATISTICS) for r in rules.measure(docs, keep=["doc_id"]).collect()}
    assert got == {i: brute_statistics(t) for i, t in enumerate(TEXTS)}


def test_base_rule_and_edges(spark, docs):
    got = rules.measure(docs.withColumn("_w", F.lit(1)), keep=["doc_id", "lang", "leaf", "stratum", "_w"])
    assert got.columns[:5] == ["doc_id", "lang", "leaf", "stratum", "_w"] and got.count() == docs.count()
    assert got.where("base_failed is null").count() == 0
    assert got.where("base_failed <> (n_words < 10 or 100 * n_repeat_words > 20 * n_words)").count() == 0
    with pytest.raises(ValueError):
        rules.measure(docs.withColumn("kept", F.lit(1)), keep=["kept"])
    # Without labels, or without rows, nothing is certified and only the base rule rejects.
    nothing = spark.createDataFrame([], "doc_id long, label int")
    for some in (got, got.where("false")):
        kept = rules.apply_cutoffs(some, rules.fit_cutoffs(some, nothing))
        assert kept.where("kept = base_failed").count() == 0 and kept.count() == some.count()


def exact_tail(k, n, p):
    return math.fsum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)) for i in range(k + 1))


def test_binomial_tail(spark):
    cases = [(k, n, p) for n in (1, 5, 200, 10_000, 1_000_000) for p in (0.02, 0.3) for k in {0, 1, 2, n // 100, int(p * n)} if k <= p * n]
    for p in (0.02, 0.3):
        ours = [(k, n) for k, n, q in cases if q == p]
        rows = spark.createDataFrame(ours, "k long, n long").withColumn("tail", rules.binomial_tail(F.col("k"), F.col("n"), p)).collect()
        for row in rows:
            assert row["tail"] == pytest.approx(exact_tail(row["k"], row["n"], p), rel=1e-6, abs=1e-300)
    beyond = spark.range(1).select(rules.binomial_tail(F.lit(5), F.lit(10), 0.02)).head()[0]
    assert beyond == 1.0


def brute_cutoffs(measured, labels, cells, false_rejection, error):
    """The method's choice per stratum, in plain Python."""
    held, design = defaultdict(list), defaultdict(list)
    for row in measured:
        label = labels.get(row["doc_id"])
        if label is not None and not row["base_failed"]:
            side = held if zlib.crc32(str(row["doc_id"]).encode()) % 2 == 1 else design
            side[row["lang"]].append((label, {c: row[f"c_{c}"] for c in cells}))
    chosen, levels = {}, {}
    for s, rows in design.items():
        good, bad = [r for y, r in rows if y == 1], [r for y, r in rows if y == 0]
        if not good or not bad:
            continue
        for c in cells:
            values = sorted({r[c] for r in good + bad})
            cuts = [min(v for v in values if sum(r[c] > v for r in good) <= share * len(good)) for share in rules.LEVELS]
            found, lost = (sum(r[c] > cuts[-1] for r in side) / len(side) for side in (bad, good))
            if found >= lost + rules.GAIN:
                levels.setdefault(s, {})[c] = cuts
    tested = {s: [r for y, r in held[s] if y == 1] for s in levels}
    tested = {s: good for s, good in tested.items() if good}
    for s, good in tested.items():
        def out(r, j, s=s):
            return any(r[c] > cuts[j] for c, cuts in levels[s].items())

        best = None
        for j in range(len(rules.LEVELS)):
            k = sum(out(r, j) for r in good)
            p = exact_tail(k, len(good), false_rejection) if k <= false_rejection * len(good) else 1.0
            if p > error / len(tested):
                break
            d_good, d_bad = [r for y, r in design[s] if y == 1], [r for y, r in design[s] if y == 0]
            gain = sum(out(r, j) for r in d_bad) / len(d_bad) - sum(out(r, j) for r in d_good) / len(d_good)
            if gain > 0 and (best is None or gain > best[0] + 1e-12):
                best = (gain, j, len(good), k, {c: cuts[j] for c, cuts in levels[s].items()})
        if best:
            chosen[s] = best[1:]
    return chosen


@pytest.mark.parametrize("false_rejection, error", [(0.02, 0.05), (0.1, 0.3)])
def test_cutoffs_against_brute_force(spark, false_rejection, error):
    measured = rules.measure(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), keep=["doc_id", "lang"]).withColumn("lang", F.when(F.col("lang") != "de", F.col("lang")))
    measured = rules.written(measured, "measured")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").select("doc_id", F.col("quality").alias("label"))
    cells = rules.rule_cells()
    rows = measured.select("*", *[v.alias(f"c_{c}") for c, v in cells.items()]).collect()
    known = {r["doc_id"]: r["label"] for r in labels.collect()}
    wanted = brute_cutoffs(rows, known, list(cells), false_rejection, error)
    cutoffs = rules.fit_cutoffs(measured, labels, false_rejection=false_rejection, error=error)
    got = {r["stratum"]: (r["level"], r["n_good"], r["n_rejected"], dict(r["cutoffs"])) for r in cutoffs.collect()}
    assert got == wanted and None in got
    kept = rules.apply_cutoffs(measured, cutoffs)
    mine = {r["doc_id"]: (r["kept"], set(r["failed_rules"])) for r in kept.collect()}
    for r in rows:
        failed = set() if r["base_failed"] else {c for c, cut in got.get(r["lang"], (0, 0, 0, {}))[3].items() if r[f"c_{c}"] > cut}
        assert mine[r["doc_id"]] == (not r["base_failed"] and not failed, failed)
    good = kept.join(labels.where("label = 1"), "doc_id").where("not base_failed")
    assert good.where("not kept").count() <= false_rejection * good.count()
    bad = kept.join(labels.where("label = 0"), "doc_id").where("not base_failed")
    assert bad.where("not kept").count() > 0.5 * bad.count()
