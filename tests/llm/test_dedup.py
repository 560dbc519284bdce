import hashlib
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from linewright.llm import rlz_dedup, simhash

from .conftest import SCHEMA, prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_copies(rows, window=50):
    """doc rows -> (n_words, n_removed, sha256), from the definition."""
    words = [(d, WORD.findall(t or "")) for d, t in rows]
    first = {}
    for d, w in words:
        if d is not None:
            for i in range(len(w) - window + 1):
                key = tuple(w[i : i + window])
                first[key] = min(first.get(key, d), d)
    result = []
    for d, w in words:
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if d is not None and first.get(tuple(w[i : i + window]), d) < d:
                gone[i : i + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        sha = hashlib.sha256(kept.encode()).hexdigest()
        result.append((d, len(w), sum(gone), sha))
    return result


def key(row):
    return (row[0] is not None, row[0] or 0, *row[1:])


def planted():
    shared, rows = prose(0, 70), []
    for i in range(40):
        own = [prose(100 + i, 30), shared, prose(200 + i, 40)]
        if i % 3 == 0:
            own[1] = " ".join(shared.split()[i % 20 : 55 + i % 15])
        if i % 7 == 0:
            own.append(own[1])
        rows.append((50 - i, "  \n".join(own)))
    rows += [(200 + i, rows[5][1]) for i in range(10)]
    rows += [(300, "a a " * 100), (301, "a " * 120), (302, prose(0, 49))]
    return rows


def test_copies_match_the_definition(docs):
    rows = planted()
    found = rlz_dedup.digest(docs(rows)).collect()
    got = [(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in found]
    assert sorted(got) == sorted(brute_copies(rows))
    # Factors cover what is removed, and copy what they say they copy.
    words = dict((d, WORD.findall(t)) for d, t in rows)
    for row in found:
        covered = set()
        for f in row.factors:
            covered |= set(range(f.start, f.start + f.length))
            if f.ref_start is not None:
                copy = words[f.ref_doc][f.ref_start : f.ref_start + f.length]
                assert words[row.doc_id][f.start : f.start + f.length] == copy
            assert f.ref_doc < row.doc_id
        assert len(covered) == row.n_removed


def test_odd_copies(odd_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    got = [
        (r.doc_id, r.n_words, r.n_removed, r.kept_sha256)
        for r in rlz_dedup.digest(odd_docs).collect()
    ]
    assert sorted(got, key=key) == sorted(brute_copies(rows), key=key)


def test_same_id_with_other_texts(docs):
    a, b = prose(5, 120), prose(6, 120)
    rows = [(1, a), (2, a + " " + b), (2, b), (2, prose(7, 30)), (3, b)]
    got = [
        (r.doc_id, r.n_words, r.n_removed, r.kept_sha256)
        for r in rlz_dedup.digest(docs(rows)).collect()
    ]
    assert sorted(got) == sorted(brute_copies(rows))


def test_remove_copies_keeps_columns(docs):
    a = prose(5, 80)
    frame = docs([(1, a), (2, "new  start " + a), (3, None), (4, "as\n it  is")])
    frame = frame.selectExpr("*", "doc_id * 2 AS t", "'x' AS h", "array(doc_id) AS found")
    out = {r.doc_id: r for r in rlz_dedup.remove_copies(frame).collect()}
    assert rlz_dedup.remove_copies(frame).columns == frame.columns
    assert out[2].text == "new start" and out[2].n_chars == len("new start")
    assert out[1].text == a and out[3].text is None and out[4].text == "as\n it  is"
    assert out[2].t == 4 and out[2].h == "x" and out[2].found == [2]


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert rlz_dedup.digest(none).count() == 0
    assert rlz_dedup.remove_copies(none).count() == 0
    assert simhash.near_duplicates(none).count() == 0


def brute_print(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = WORD.findall(lowered)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(
        1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)
    )


def brute_groups(prints):
    ids = sorted(prints)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_fingerprints_and_groups(docs):
    base = prose(9, 400).split()
    rows = [(1, None), (2, " "), (3, "one"), (4, "ONE"), (5, "one two")]
    for i in range(60):
        words = list(base)
        words[i * 5] = "changed"
        rows.append((100 - i, " ".join(words)))
    rows += [(200 + i, prose(300 + i, 20 + i * 30)) for i in range(20)]
    rows += [(400, prose(9, 400).upper())]
    prints = {d: brute_print(t) for d, t in rows}
    want = brute_groups(prints)
    got = {r.doc_id: r for r in simhash.digest(simhash.near_duplicates(docs(rows))).collect()}
    assert {d: r.fingerprint for d, r in got.items()} == {
        d: f"{p:016x}" for d, p in prints.items()
    }
    assert {d: r.component_id for d, r in got.items()} == want


@pytest.mark.parametrize("bucket", [8192, 7])
def test_links_in_crowded_buckets(spark, bucket):
    random = np.random.default_rng(3)
    seeds = random.integers(0, 2**64, 6, dtype=np.uint64)
    prints = set(seeds.tolist()) | {0, 1, 3, 2**64 - 1}
    for seed in seeds.tolist():
        walk = seed
        for _ in range(150):
            for bit in random.integers(0, 64, random.integers(1, 5)):
                walk ^= 1 << int(bit)
            prints.add(walk)
    prints = sorted(prints)
    named = dict(enumerate(prints))
    signed = simhash.signed(np.array(prints, dtype=np.uint64)).tolist()
    nodes = spark.createDataFrame(list(zip(signed, range(len(signed)))), "fp bigint, node bigint")
    links = simhash.close_links(nodes, bucket=bucket).collect()
    root = {i: i for i in named}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for r in links:
        a, b = find(r.a), find(r.b)
        root[max(a, b)] = min(a, b)
    assert {i: find(i) for i in named} == brute_groups(named)


@pytest.mark.parametrize("radius", [0, 1, 3, 5])
def test_bit_sliced_distances(radius):
    random = np.random.default_rng(radius)
    prints = random.integers(0, 2**64, 64, dtype=np.uint64)
    near = prints ^ (np.uint64(1) << random.integers(0, 64, 64, dtype=np.uint64))
    near[::3] ^= np.uint64(0b1011)
    queries = np.stack([prints, near])
    planes = np.concatenate([simhash.bit_planes(near), simhash.bit_planes(prints)])
    masks = simhash.within_radius(queries, planes, radius)
    for row, other in enumerate([near, prints]):
        for q in range(64):
            for t in range(64):
                close = int(queries[row, q] ^ other[t]).bit_count() <= radius
                assert bool(int(masks[row, q]) >> t & 1) == close


def test_long_counts_of_bits():
    n = np.array([0, 1, 255, 256, 1000])
    random = np.random.default_rng(1)
    hashes = random.integers(0, 2**64, int(n.sum()), dtype=np.uint64)
    hashes[1:256] |= np.uint64(1 << 63)
    got, at = simhash._majority(hashes, n), 0
    for size, value in zip(n.tolist(), got.tolist()):
        own = hashes[at : at + size].tolist()
        want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in own) > size)
        assert value == want
        at += size


def test_keep_first(odd_docs):
    out = simhash.keep_first(odd_docs)
    ids = [r.doc_id for r in out.collect()]
    assert out.columns == odd_docs.columns
    # Texts without words are one group; of equal rows with the same id one stays.
    assert 1 in ids and 2 not in ids and 3 not in ids
    assert 6 in ids and 7 not in ids and ids.count(8) == 1 and None in ids


def test_words_of_sliced_arrays():
    from linewright.llm.common import Words

    texts = pa.array(["skip", "a b", None, "", "cd\n", "  e "]).slice(1)
    words = Words(texts)
    assert words.first.tolist() == [0, 2, 2, 2, 3, 4]
    assert [words.data[a:b].tobytes() for a, b in zip(words.start, words.end)] == [
        b"a", b"b", b"cd", b"e"
    ]
    assert words.hashes().tolist() == Words(pa.array(["a b cd e"])).hashes().tolist()
