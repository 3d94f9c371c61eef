"""Near, substring and suffix dedup against plain versions."""

import dataclasses
import hashlib
import re

import numpy as np
import pytest

from sievework.llm import near_dedup, spans, substring_dedup, suffix_dedup
from tests.conftest import SMALL, same
from tests.llm.fixtures import documents, pairs_of

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_near(rows):
    low = str.maketrans({c: c + 32 for c in range(65, 91)})
    sets = {}
    for i, t in rows:
        w = WORD.findall((t or "").translate(low))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return {i: (len(sets[i]), find(i), find(i) == i) for i in sets}


def test_near(spark):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_dedup.classes(documents(spark)).collect()}
    assert got == plain_near(pairs_of())
    kept = near_dedup.one_of_each(documents(spark))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, v in got.items() if v[2]) and kept.columns == documents(spark).columns


def test_near_chain(spark):
    """Neighbours of a chain are linked, its ends are not; the group is larger than a block and star pairs alone miss
    links."""
    base = [f"w{i}" for i in range(104)]
    rows = []
    for k in range(60):
        w = list(base)
        for j in range(k):
            w[j] = f"v{j}"  # one word more differs at each step
        rows.append((k, " ".join(w)))
    rng = np.random.default_rng(0)
    rows = [(int(i), t) for i, (_, t) in zip(rng.permutation(60), rows, strict=True)]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_dedup.classes(documents(spark, rows)).collect()}
    assert got == plain_near(rows)


def test_sketch_estimates_similarity():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 1 << 63, 1000).astype(np.uint64)
    s = near_dedup.sketches([np.unique(x[:900]), np.unique(x[100:]), np.unique(x[:3])])
    assert (s != near_dedup._EMPTY).all()
    assert abs((s[0] == s[1]).mean() - 0.8) < 0.15


def plain_suffix(rows):
    rows = [(i, (t or "").encode()) for i, t in rows]
    low = {}
    for i, t in sorted(rows):
        for p in range(len(t) - 49):
            low.setdefault(t[p : p + 50], i)
    out = []
    for i, t in rows:
        gone = np.zeros(len(t), bool)
        for p in range(len(t) - 49):
            if low[t[p : p + 50]] < i:
                gone[p : p + 50] = True
        kept = np.frombuffer(t, np.uint8)[~gone].tobytes()
        out.append((i, len(t), int(gone.sum()), int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def plain_cleaned(rows):
    """Rows with the text that stays, a code point going if one of its bytes does; emptied texts go."""
    low, out = {}, []
    for i, t in sorted(rows):
        b = t.encode()
        for p in range(len(b) - 49):
            low.setdefault(b[p : p + 50], i)
    for i, t in rows:
        b = t.encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - 49):
            if low[b[p : p + 50]] < i:
                gone[p : p + 50] = True
        at = np.cumsum([0] + [len(c.encode()) for c in t])
        left = "".join(c for k, c in enumerate(t) if not gone[at[k] : at[k + 1]].any())
        if left or not t:
            out.append((i, left))
    return out


@pytest.mark.parametrize("hot,block", [(1000, 1 << 20), (2, 3000)])
def test_suffix(spark, hot, block):
    kind = dataclasses.replace(suffix_dedup.KIND, hot_blocks=hot)
    got = spans.repeated(documents(spark), kind, block_bytes=block).mapInArrow(suffix_dedup._rows, suffix_dedup.RESULT)
    assert sorted(map(tuple, got.collect())) == plain_suffix(pairs_of())


def test_suffix_repeated_ids(spark):
    t = pairs_of()[0][1]
    rows = [(3, t), (3, t), (5, t), (4, t[10:120])]
    got = suffix_dedup.removals(documents(spark, rows))
    assert sorted(map(tuple, got.collect())) == plain_suffix(rows)


def plain_words(rows):
    rows = [(i, WORD.findall(t or "")) for i, t in rows]
    low = {}
    for i, w in sorted(rows, key=lambda x: x[0]):
        for p in range(len(w) - 49):
            low.setdefault(tuple(w[p : p + 50]), i)
    out = []
    for i, w in rows:
        gone = set()
        for p in range(len(w) - 49):
            if low[tuple(w[p : p + 50])] < i:
                gone.update(range(p, p + 50))
        out.append((i, len(w), len(gone), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("hot,block", [(1000, 1 << 20), (2, 3000)])
def test_substring(spark, hot, block):
    kind = dataclasses.replace(substring_dedup.KIND, hot_blocks=hot)
    got = spans.repeated(documents(spark), kind, block_bytes=block).mapInArrow(substring_dedup._rows, substring_dedup.RESULT)
    assert sorted(map(tuple, got.collect())) == plain_words(pairs_of())


def test_factors_check_their_ends():
    a, b = [f"a{i}".encode() for i in range(60)], [f"b{i}".encode() for i in range(60)]
    ref = substring_dedup.Reference()
    ref.add(a)
    ref.add(a[30:] + b[:40])
    # behind the factor a[0:60] a window that begins inside it lies whole in the other string
    assert substring_dedup.factors(a + b[:40], ref) == [(0, 60), (30, 70)]


@pytest.mark.parametrize("alphabet", [1024, 1])
def test_suffix_array(monkeypatch, alphabet):
    monkeypatch.setattr(suffix_dedup, "ARRAY_ALPHABET", alphabet)
    for seed in range(150):
        rng = np.random.default_rng(seed)
        n, sigma = int(rng.integers(1, 70)), int(rng.integers(1, 5))
        s = np.append(rng.integers(1, sigma + 1, n), 0)
        sa = suffix_dedup.suffix_array(s, sigma + 1)
        assert sa.tolist() == sorted(range(n + 1), key=lambda i: s[i:].tolist())
        plcp = suffix_dedup.common_prefixes(s, sa, 20)
        for i in range(1, n + 1):
            a, b = s[sa[i] :], s[sa[i - 1] :]
            m = min(len(a), len(b), 20)
            differ = np.flatnonzero(a[:m] != b[:m])
            assert plcp[sa[i]] == (differ[0] if len(differ) else m)


def test_cleaned_texts(spark):
    docs = documents(spark)
    out = {r["doc_id"]: r for r in suffix_dedup.dedup(docs).collect()}
    plain = {r[0]: r for r in plain_suffix(pairs_of())}
    for i, t in pairs_of():
        if plain[i][2] == 0:
            assert out[i]["text"] == (t or "")
        elif plain[i][2] == plain[i][1]:
            assert i not in out
        else:
            assert out[i]["n_chars"] == len(out[i]["text"]) and out[i]["lang"] == "en"
    assert suffix_dedup.dedup(docs).schema.names == docs.schema.names


def test_empty_tables(spark):
    none = documents(spark, [])
    assert near_dedup.classes(none).count() == 0
    assert suffix_dedup.removals(none).count() == 0
    assert substring_dedup.removals(none).count() == 0
    assert suffix_dedup.dedup(none).count() == 0 and near_dedup.one_of_each(none).count() == 0


def test_null_ids(spark):
    t = pairs_of()[0][1]
    rows = [(None, t), (2, t), (None, None), (2, None)]
    assert near_dedup.classes(documents(spark, rows)).count() == 4
    got = {(r["doc_id"], r["n_bytes"]): r["n_removed"] for r in suffix_dedup.removals(documents(spark, rows)).collect()}
    assert got[(None, len(t))] == len(t) and got[(2, len(t))] == 0
    assert substring_dedup.removals(documents(spark, rows)).count() == 4


@pytest.mark.parametrize("module", [near_dedup, substring_dedup, suffix_dedup])
def test_against_sql(spark, duck, module):
    assert same(module.query(spark, SMALL), duck.execute(module.ORACLE))


def test_cut_points_go_whole(spark):
    """The shared bytes begin and end inside code points; what is left of two of them is no new one."""
    core = "z" * 60
    rows = [(1, "\u00a9" + core + "\u00e9 tail"), (2, "begin \u00e9" + core + "\u00e8 end")]
    out = {r["doc_id"]: r["text"] for r in suffix_dedup.dedup(documents(spark, rows)).collect()}
    assert out == {1: rows[0][1], 2: "begin  end"}
    data = np.frombuffer("a\u65e5\u672cb".encode(), np.uint8)
    assert spans.without_points(data, np.arange(8) == 3) == "a\u672cb".encode()


def test_near_threshold(spark):
    """86 common shingles of 106: linked in the pipeline, not in op6_near_dedup."""
    import corpus_pipeline

    base = [f"w{i}" for i in range(100)]
    rows = [(1, " ".join(base)), (2, " ".join({30: "x", 70: "y"}.get(i, w) for i, w in enumerate(base)))]
    docs = documents(spark, rows)
    assert [r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, SMALL).collect()] == [1]
    assert near_dedup.one_of_each(docs).count() == 2


def test_near_threshold_across_blocks(spark):
    """A link at 0.81 between two components of a cluster; a sketch may agree in fewer coordinates than at 0.85."""
    assert near_dedup.agreeing(80) < near_dedup.agreeing(85)
    rng = np.random.default_rng(3)
    x = rng.permutation(1 << 20)[:106].astype(np.uint64)
    sets = [np.sort(x[:96]), np.sort(x[10:])]
    cols = {"block": [1, 1], "side": [0, 1], "member": [1, 2], "main": [False, True], "component": [1, 2], "members": [s.tobytes() for s in sets], "sketch": [b"\0" * 128, b"\0" * 76 + b"\1" * 52]}
    held = near_dedup.pa.RecordBatch.from_pydict(cols)
    assert [b.to_pydict() for b in near_dedup._across(80)(iter([held]))] == [{"a": [1], "b": [2]}]
    assert not list(near_dedup._across(85)(iter([held])))


def test_near_templates(spark):
    """Documents of one template share 150 of 195 words and aren't linked; a few that also share the rest are."""
    rng = np.random.default_rng(5)
    template = " ".join(f"t{i}" for i in range(150))
    own = [" ".join(f"u{x}" for x in rng.integers(0, 1 << 40, 45)) for _ in range(150)]
    rows = [(i, f"{template} {w}") for i, w in enumerate(own)]
    # links of the template's documents that no bucket's smallest member shows
    rows += [(1000 + i, f"{template} {own[100 + i]} more words {i}") for i in range(10)]
    rows += [(2000 + i, f"{template} {' '.join(own[110].split()[: 45 - i])} end{i}") for i in range(12)]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_dedup.classes(documents(spark, rows)).collect()}
    assert got == plain_near(rows)


@pytest.mark.parametrize("threshold", [80, 85])
def test_rare_shingles_lose_no_link(spark, threshold):
    """Random sets, all in components of their own: every link's members meet."""
    rng = np.random.default_rng(threshold)
    pool = rng.permutation(1 << 30)[:300].astype(np.uint64)
    sets = []
    for _ in range(12):
        base = rng.choice(pool, rng.integers(8, 60), replace=False)
        sets.append(np.unique(base))
        for _ in range(3):
            sets.append(np.unique(np.concatenate([base[rng.integers(0, 9) :], rng.choice(pool, rng.integers(0, 5))])))
    rows = spark.createDataFrame([(i, i, bytearray(s.tobytes())) for i, s in enumerate(sets)], "member long, component long, members binary")
    cluster = {r["member"]: r["cluster"] for r in near_dedup.meeting(rows, threshold).collect()}
    links = 0
    for i, a in enumerate(sets):
        for j in range(i):
            both = len(np.intersect1d(a, sets[j]))
            if 100 * both >= threshold * (len(a) + len(sets[j]) - both):
                links += 1
                assert cluster[i] == cluster[j]
    assert links > 10


@pytest.mark.parametrize("module,plain", [(suffix_dedup, plain_suffix), (substring_dedup, plain_words)])
@pytest.mark.parametrize("hot", [3, 1000])
def test_many_blocks_are_counted_by_groups(spark, monkeypatch, module, plain, hot):
    """The tree of tallies that very many blocks have gives the same."""
    monkeypatch.setattr(spans, "TREE_BLOCKS", 2)
    monkeypatch.setattr(spans, "GROUP_BLOCKS", 3)
    kind = dataclasses.replace(module.KIND, hot_blocks=hot)
    got = spans.repeated(documents(spark), kind, block_bytes=3000).mapInArrow(module._rows, module.RESULT)
    assert sorted(map(tuple, got.collect())) == plain(pairs_of())


@pytest.mark.parametrize("module,plain", [(suffix_dedup, plain_suffix), (substring_dedup, plain_words)])
def test_passage_in_every_block(spark, module, plain):
    """One passage with other surroundings everywhere, often in a block, and one key with many distinct surroundings."""
    rng = np.random.default_rng(2)
    words = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 1 << 30, n))
    passage = words(70)
    rows = [(int(i), f"{words(int(rng.integers(1, 30)))} {passage} {words(20)}") for i in rng.permutation(240)]
    want = plain(rows)
    for hot in (4, 60, 1000):
        kind = dataclasses.replace(module.KIND, hot_blocks=hot)
        got = spans.repeated(documents(spark, rows), kind, block_bytes=20000).mapInArrow(module._rows, module.RESULT)
        assert sorted(map(tuple, got.collect())) == want
    hot = dataclasses.replace(module.KIND, hot_blocks=4)
    sent = spans.blocks(documents(spark, rows), False, 20000).select("block", "ids", "sizes", "data").mapInArrow(spans._anchors(hot, 1), spans.ANCHORS)
    sent = sent.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(spans._answers(hot), spans.ANSWERS).collect()
    assert any((spans.unpack(r["keys"]) & np.uint64(1)).any() for r in sent)


def test_largest_id_is_no_null(spark):
    t = pairs_of()[0][1]
    rows = [(None, t), (2**63 - 1, t)]
    got = {(r["doc_id"], r["n_removed"]) for r in suffix_dedup.removals(documents(spark, rows)).collect()}
    assert {i for i, _ in got} == {None, 2**63 - 1}


def test_runs_of_a_key_are_summed():
    flags = [(5, 0, 0), (5, 2, 1), (7, 3, 0)]
    keys, back, blocks, runs, many = spans._tallied(np.array([k << 3 | often << 1 | several for k, often, several in flags], np.uint64))
    assert keys.tolist() == [5, 7] and back.tolist() == [0, 0, 1] and blocks.tolist() == [2, 1] and many.tolist() == [True, False]
    assert runs.tolist() == [1 + 512, 8192] and 4 * 8192 >= spans.HOT_RUNS


def test_links_of_all_texts_of_an_id(spark):
    """Two texts under id 5 and a near copy of each: both links count, and id 5 stays."""
    a, b = (" ".join(f"{c}{i}" for i in range(80)) for c in "ab")
    rows = [(5, a), (5, b), (7, a + " end"), (9, b + " end"), (11, "other words " * 10), (None, a), (3, None)]
    for order in (rows, rows[::-1]):
        got = sorted(((r["doc_id"], r["component_id"], r["kept"]) for r in near_dedup.classes(documents(spark, order)).collect()), key=str)
        assert got == sorted([(5, 5, True), (5, 5, True), (7, 5, False), (9, 5, False), (11, 11, True), (None, 5, True), (3, 3, True)], key=str)
        assert sorted(str(r["doc_id"]) for r in near_dedup.one_of_each(documents(spark, order)).collect()) == sorted(["5", "5", "11", "None", "3"])
    # an id whose one text is a copy of a smaller id stays for the sake of its other text
    kept = near_dedup.one_of_each(documents(spark, [(3, a), (5, a), (5, b), (9, b + " end")]))
    assert sorted(r["doc_id"] for r in kept.collect()) == [3, 5, 5]


def test_long_runs_take_no_longer_than_other_texts():
    import time

    for text in (b"=" * (1 << 20), b"ab" * (1 << 19), b" " * 3000 + b"x" + b" " * (1 << 20)):
        began = time.time()
        out = suffix_dedup.match([text, text[: 1 << 19]], np.array([1, 2]), np.zeros(2, int))
        assert out == [[], [(0, 1 << 19)]] and time.time() - began < 20  # a loop turn a byte took minutes


def test_periodic_texts(spark):
    """Runs of windows with one key are cut in pieces; every window stays in one of them."""
    rows = [(1, "=" * 20_000), (2, "-" + "=" * 9_000 + "-" * 60), (3, "ab" * 5_000), (4, "b" + "ab" * 2_100 + "c"), (5, "=" * 49), (6, "x" + "=" * 50), (7, "abc " * 3_000), (8, "c " + "abc " * 4_000)]
    assert sorted(map(tuple, suffix_dedup.removals(documents(spark, rows)).collect())) == plain_suffix(rows)
    words = [(1, "a " * 9_000), (2, "b " + "a " * 6_000), (3, "x y " * 3_000), (4, "z " + "y x " * 3_500)]
    assert sorted(map(tuple, substring_dedup.removals(documents(spark, words)).collect())) == plain_words(words)


def test_only_segments_with_a_common_window_are_sorted(monkeypatch):
    """Segments that share a key but no window cost a hash a window, not a place in the suffix array."""
    rng = np.random.default_rng(3)
    text = lambda n: bytes(rng.integers(97, 123, n, np.uint8))
    gram = text(20)
    apart = [text(40) + gram + text(40) for _ in range(500)]
    common = [b"a" + gram + text(30), None]
    common[1] = b"b" + common[0][1:]
    sizes, sort = [], suffix_dedup.suffix_array
    monkeypatch.setattr(suffix_dedup, "suffix_array", lambda s, sigma: sizes.append(len(s)) or sort(s, sigma))
    segments = [*apart, *common]
    assert suffix_dedup.match(segments, np.arange(len(segments)), np.zeros(len(segments), int)) == [[] for _ in segments[:-1]] + [[(1, 50)]]
    assert sizes[0] == sum(map(len, common)) + 3
    sizes.clear()
    assert suffix_dedup.match(apart, np.arange(len(apart)), np.zeros(len(apart), int)) == [[] for _ in apart] and not sizes
    assert suffix_dedup.match([b"x"], np.zeros(1, int), np.zeros(1, int)) == [[]]
