from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa

from lodestream.llm import op3_parity_join as op3
from lodestream.llm.components import components
from tests.llm.conftest import DOCS


def shingles(text):
    words = re.findall("[^\x20\x09-\x0d]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4)) if len(words) >= 5 else frozenset([tuple(words)] if words else [])


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    inverted = defaultdict(list)
    for i, s in enumerate(sets):
        for j, n in Counter(j for t in s for j in inverted[t]).items():
            if 100 * n >= 80 * (len(s) + len(sets[j]) - n):
                parent[find(i)] = find(j)
        for t in s:
            inverted[t].append(i)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted((d, len(s), least.get(find(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True)) if d is not None)


def near_copies():
    """A group of near copies, chains, borderline pairs, sets at the ends of bands, a passage that all share."""
    rnd = random.Random(3)
    shared = [f"s{i}" for i in range(12)]
    rows = []
    for n in [*range(4, 40), 63, 64, 65, 79, 80, 81, 127, 128, 129, 159, 161, 300]:
        base = [f"n{n}w{i}" for i in range(n + 4)]
        rows.append(base + shared)
        rows.append(base[: len(base) - rnd.randint(0, n // 4)] + shared)
        edited = list(base)
        edited[rnd.randrange(len(base))] = "x"
        rows.append(edited + shared)
    base = [f"g{i}" for i in range(200)]
    for _ in range(120):
        base = list(base)
        base[rnd.randrange(200)] = f"e{rnd.randrange(10**6)}"
        rows.append(base)
    return [(i, " ".join(w)) for i, w in enumerate(rows)]


def run(spark, folder):
    got = op3.op3_parity_join(spark, folder).collect()
    return len(got), sorted(tuple(r) for r in got if r.doc_id is not None)


def test_query_equals_brute_force(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert run(spark, sf) == (len(rows), brute(rows))


def test_links_of_near_copies(spark, write):
    rows = near_copies()
    assert run(spark, write([(i, t, None, None, None) for i, t in rows], DOCS)) == (len(rows), brute(rows))


def test_awkward_rows(spark, awkward, write):
    n, got = run(spark, write(awkward, DOCS))
    assert n == len(awkward) and got == brute([r[:2] for r in awkward])
    assert run(spark, write([], DOCS)) == (0, [])


def test_linked_sets_share_a_key_and_sketches_bound_the_difference():
    rnd = random.Random(1)
    for _ in range(200):
        n = rnd.randint(4, 300)
        a = [f"w{rnd.randrange(10**9)}" for _ in range(n + 4)]
        b = a[: len(a) - rnd.randint(0, n // 5)]
        sets, bounds = op3.shingle_sets(pa.array([" ".join(a), " ".join(b)]))
        x, y = (set(sets[bounds[i] : bounds[i + 1]].tolist()) for i in (0, 1))
        sketches = [np.frombuffer(s, np.uint8) for s in op3.bit_sketches(sets, bounds, np.array([0, 1]))]
        assert op3.hamming(*sketches) <= len(x ^ y)
        if 100 * len(x & y) >= 80 * len(x | y):
            keys = []
            for i in (0, 1):
                size = int(bounds[i + 1] - bounds[i])
                own = size.bit_length() - 1
                bands = [own, own - 1] if size * 4 < (1 << own) * 5 else [own]
                keys.append({k for band in bands for k in op3.band_keys(sets, bounds, np.array([i]), np.array([band]), np.zeros(0, np.uint64))[1].tolist()})
            assert keys[0] & keys[1]


def emitted(texts):
    """Keys of each class by its name, as the join gets them."""
    frequent = type("Sent", (), {"value": np.zeros(0, np.uint64)})
    keys = defaultdict(set)
    for batch in op3.emit_keys(frequent)(iter([pa.record_batch({"text": pa.array(texts)})])):
        for key, name in zip(batch.column("key").to_pylist(), batch.column("class").to_pylist(), strict=True):
            keys[name].add(key)
    return keys


def short_pairs(count):
    """Texts of 4, 5 and 6 shingles, each with a longer one by a word: linked."""
    rnd = random.Random(7)
    for n in (4, 5, 6):
        for _ in range(count):
            words = [f"w{rnd.randrange(10**9)}" for _ in range(n + 5)]
            yield " ".join(words[:-1]), " ".join(words)


def test_all_short_linked_sets_share_a_key():
    pairs = list(short_pairs(8000))
    texts = [t for p in pairs for t in p]
    keys = emitted(texts)
    names = op3.class_of(*op3.shingle_sets(pa.array(texts))).tolist()
    assert all(keys[a] & keys[b] for a, b in zip(names[::2], names[1::2], strict=True))


def test_linked_sets_of_all_small_sizes_share_a_key():
    """40,000 linked pairs of 4 to 40 shingles, as far apart as links allow, and a pair that once was lost."""
    rnd = random.Random(17)
    lost = "w157413274 w740954425 w583226946 w981556560 w29036651 w814049802 w567053193 w320071361"
    pairs = [(lost, lost + " w690326952")]
    for n in range(4, 41):
        for _ in range(1081):
            words = [f"w{rnd.randrange(10**9)}" for _ in range(n + 4)]
            gone = rnd.randint(0, n // 5) if n % 2 else n // 5
            front = rnd.randint(0, gone)
            pairs.append((" ".join(words), " ".join(words[front : len(words) - (gone - front)])))
    texts = [t for p in pairs for t in p]
    keys = emitted(texts)
    names = op3.class_of(*op3.shingle_sets(pa.array(texts))).tolist()
    assert len(pairs) > 39_000 and all(a == b or keys[a] & keys[b] for a, b in zip(names[::2], names[1::2], strict=True))


def rows_of(batches, columns):
    return [tuple(r[c] for c in columns) for b in batches for r in b.to_pylist()]


def test_hot_keys_in_parts_give_the_same(monkeypatch):
    """Keys with 5,000 classes and with few, taken whole and in parts of some hundred rows."""
    rng = np.random.default_rng(4)
    key = np.concatenate([np.full(5000, 7), np.repeat(np.arange(100, 400), rng.integers(1, 6, 300)), np.full(3000, 900)])
    name = rng.integers(0, 10**6, len(key))
    table = pa.table({"key": key, "class": name, "n": 90 + name % 30, "root": name % 50, "met": name % 97})
    table = table.sort_by([("key", "ascending"), ("class", "ascending")])
    hubbed = table.sort_by([("key", "ascending"), ("met", "descending"), ("class", "ascending")])
    got = {}
    for block in (1 << 30, 1 << 12):
        monkeypatch.setattr(op3, "BLOCK", block)
        buckets = rows_of(op3.bucket(iter(table.to_batches(200))), ("kind", "a", "b", "n"))
        got[block] = {r for r in buckets if r[0] == 0}, {r for r in buckets if r[0] == 1}, set(rows_of(op3.hubs(iter(hubbed.to_batches(200))), ("a", "b")))
    whole, parts = got.values()
    assert whole[0] == parts[0] and whole[1] == parts[1] and whole[2] == parts[2] and len(whole[2]) > 1000


def test_blocks_of_a_key_meet_once(spark):
    rows = [(1, i, 100, i % 3, 100, bytes(8)) for i in range(100)] + [(2, i, 100, i, 2, bytes(8)) for i in range(2)]
    dealt = op3.in_blocks(spark.createDataFrame(rows, "key long, class long, n long, root long, size long, small binary"), 16).collect()
    met = Counter()
    groups = defaultdict(list)
    for r in dealt:
        groups[r.key, r.lo, r.hi].append(r)
    assert max(map(len, groups.values())) < 80
    for (key, lo, hi), own in groups.items():
        met.update((key, a["class"], b["class"]) for a in own for b in own if a["class"] < b["class"] and (lo == hi or a.block != b.block))
    assert len(met) == 100 * 99 // 2 + 1 and set(met.values()) == {1}
    table = spark.createDataFrame(dealt).sort("key", "lo", "hi").toArrow()
    found = rows_of(op3.across(iter(table.to_batches())), ("a", "b"))
    assert len(found) == len(set(found)) and set(found) >= {(a, b) for a in range(100) for b in range(a + 1, 100) if a % 3 != b % 3}


def test_copies_under_null_ids(spark, write):
    """Many rows without an id, of many classes: each class's text is fetched for itself."""
    base = [f"w{i}" for i in range(40)]
    texts = [" ".join([*base[:39], f"x{i}"]) for i in range(30)] * 4
    got = op3.op3_parity_join(spark, write([(None, t, None, None, None) for t in texts] + [(9, " ".join(base), None, None, None)], DOCS)).collect()
    assert len(got) == 121 and {r.component_id for r in got} == {9}


def test_short_linked_texts_are_one_component(spark, write):
    rows = [t for p in short_pairs(1500) for t in p]
    got = {r.doc_id: r.component_id for r in op3.op3_parity_join(spark, write([(i, t, None, None, None) for i, t in enumerate(rows)], DOCS)).collect()}
    assert got == {i: i - i % 2 for i in range(len(rows))}


def test_texts_over_a_slice(spark, write):
    """Near copies of 3 MB each."""
    words = [f"word{i}" for i in range(320_000)]
    rows = [(i, " ".join(words[: len(words) - 10 * i]), None, None, None) for i in range(3)] + [(3, " ".join(words[:200_000]), None, None, None)]
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in op3.op3_parity_join(spark, write(rows, DOCS)).collect())
    assert got == [(0, 319_996, 0), (1, 319_986, 0), (2, 319_976, 0), (3, 199_996, 3)] and len(rows[0][1]) > 2 * 2**20


def test_components(spark):
    links = [(1, 2), (2, 3), (3, 4), (10, 9), (9, 8), (20, 20), (5, 6), (6, 5)] + [(i, i + 1) for i in range(100, 160)]
    got = dict(map(tuple, components(spark.createDataFrame(links, "a long, b long")).collect()))
    want = {1: 1, 2: 1, 3: 1, 4: 1, 8: 8, 9: 8, 10: 8, 5: 5, 6: 5} | {i: 100 for i in range(100, 161)}
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
