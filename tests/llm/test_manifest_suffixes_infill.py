"""Manifest proofs, repeated passages and infilling: brute force, odd rows, hot groups."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from attestra.llm import fill_middle, merkle, suffix_dedup, suffixes
from attestra.llm.shared import Workspace

from .test_operators import CLASH, COLUMNS, odd_rows


@pytest.fixture(scope="module")
def odd(spark):
    df = spark.createDataFrame([(*r, len(r[1] or "")) for r in odd_rows()], COLUMNS)
    return df.select("*", *(F.lit(1).alias(c) for c in (*CLASH, "at", "range", "tag", "places", "path", "load", "tree", "n", "form", "h1", "word", "whole")))


@pytest.fixture
def ws(spark):
    return Workspace(spark)


def sha(s):
    return hashlib.sha256(s if isinstance(s, bytes) else s.encode()).hexdigest()


# ---- manifest


def climb(nodes):
    """Each node's siblings at every level, left and right, and the root; by plain loops."""
    paths, spots = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for path, spot in zip(paths, spots):
            run = nodes[spot // 3 * 3 : spot // 3 * 3 + 3]
            path.append(("".join(run[: spot % 3]), "".join(run[spot % 3 + 1 :])))
        nodes = [sha("".join(nodes[i : i + 3])) for i in range(0, len(nodes), 3)]
        spots = [s // 3 for s in spots]
    return paths, nodes[0]


def brute_proofs(rows):
    sources = sorted({r[0] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: sorted((r for r in rows if r[0] == s), key=lambda r: (r[1] is not None, r[1] or 0, r[2])) for s in sources}
    below = {s: climb([r[2] for r in trees[s]]) for s in sources}
    above, root = climb([below[s][1] for s in sources])
    return root, sorted((str(r[1]), r[2], below[s][1], [*below[s][0][i], *above[k]]) for k, s in enumerate(sources) for i, r in enumerate(trees[s]))


@pytest.mark.parametrize("sizes", [[1], [2], [1, 1], [1, 1, 1, 1], [3, 1], [4, 9, 1, 10], [28, 0, 1, 81, 2], [300, 1, 5, 1, 1, 1, 1, 1, 1, 1, 1]])
def test_proofs_are_those_of_plain_loops(spark, ws, sizes):
    rows = [(None if k == 1 else f"s{k}", i * 7 % 1000, sha(f"{k} {i}"), f"{i}") for k, n in enumerate(sizes) for i in range(n)]
    proofs = merkle.prove(spark.createDataFrame(rows, "source string, doc_id long, leaf string, load string").repartition(5), ws)
    got = proofs.leaves.join(proofs.sources, "tree").collect()
    root, wanted = brute_proofs(rows)
    assert [r.root for r in proofs.root.collect()] == [root]
    assert sorted((str(r.doc_id), r.leaf, r.subroot, [(s.left.hex(), s.right.hex()) for s in r.path]) for r in got) == wanted
    assert sorted(r.load for r in got) == sorted(r[3] for r in rows)


def test_folds_reach_the_root_and_tampered_ones_dont(spark, ws):
    rows = [(f"s{i % 4}", i, sha(str(i)), sha(f"not {i}")) for i in range(50)]
    proofs = merkle.prove(spark.createDataFrame(rows, "source string, doc_id long, leaf string, load string"), ws)
    root = proofs.root.first().root
    both = proofs.leaves.select(merkle.folded(F.col("leaf"), F.col("path")).alias("own"), merkle.folded(F.col("load"), F.col("path")).alias("other")).collect()
    assert all(r.own == root and r.other != root for r in both)


def test_manifest_of_odd_rows_and_of_none(spark, odd, tmp_path):
    odd.write.parquet(str(tmp_path / "a" / "documents.parquet"))
    odd.where("false").write.parquet(str(tmp_path / "b" / "documents.parquet"))
    rows = merkle.op11_merkle_manifest(spark, str(tmp_path / "a")).collect()
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r: sha("".join(map(field, (r[0], r[3], r[2], len(r[1] or ""), r[1]))))
    assert sorted(r.leaf for r in rows) == sorted(map(leaf, odd_rows()))
    cut = {r[0] for r in odd_rows() if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and "\n" in (r[1] or "")}
    assert {r.doc_id for r in rows if not r.verified} == cut and len({r.root for r in rows}) == 1
    empty = merkle.op11_merkle_manifest(spark, str(tmp_path / "b"))
    assert empty.count() == 0 and empty.columns == list(rows[0].asDict())


# ---- repeated passages


def brute_cut(rows):
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for k in range(len(b) - 49):
            first[b[k : k + 50]] = min(i, first.get(b[k : k + 50], i))
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - 49):
            if first[b[k : k + 50]] < i:
                gone[k : k + 50] = True
        runs = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()) if len(b) else 0
        out.append((i, len(b), int(gone.sum()), runs, sha(bytes(np.frombuffer(b, np.uint8)[~gone]))))
    return sorted(out)


def passages(seed=3, n=60):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdeé中") for _ in range(rnd.randint(1, 9)))
    text = lambda k: " ".join(word() for _ in range(k))
    shared, rows = [text(k) for k in (9, 12, 25, 80)], []
    for i in range(n):
        body = [text(rnd.randint(0, 40)) for _ in range(3)]
        for s in rnd.sample(shared, rnd.randint(0, 3)):
            a, b = sorted(rnd.sample(range(len(s) + 1), 2))
            body.insert(rnd.randint(0, 3), rnd.choice([s, s, s[a:b]]))
        rows.append((i, " ".join(body)))
    rows += [(n + 1, rows[5][1]), (n + 2, rows[5][1] + " more"), (n + 3, "ab" * 200), (n + 4, "ab" * 60), (n + 5, "x" * 49), (n + 6, "x" * 50), (n + 7, "x" * 51), (n + 8, None), (n + 9, "")]
    return rows


@pytest.mark.parametrize("ranged,at_once", [(1 << 20, 1 << 20), (200, 1 << 20), (50, 128)])
def test_cuts_are_those_of_brute_force(spark, tmp_path, monkeypatch, ranged, at_once):
    """Also with ranges so small that passages lie on splitters, and with texts in pieces."""
    monkeypatch.setattr(suffix_dedup, "PER_RANGE", ranged)
    monkeypatch.setattr(suffix_dedup, "STRETCHES", max(8, ranged // 64))
    monkeypatch.setattr(suffixes, "AT_ONCE", at_once)
    rows = passages()
    random.Random(1).shuffle(rows)
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = suffix_dedup.op12_suffix_dedup(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == brute_cut(rows)


def test_one_passage_in_every_document(spark, tmp_path, monkeypatch):
    """A passage that lies on splitters, with unlike neighbours: the first document keeps it, all others lose it."""
    monkeypatch.setattr(suffix_dedup, "PER_RANGE", 30)
    monkeypatch.setattr(suffix_dedup, "STRETCHES", 10)
    rnd = random.Random(5)
    line = "all of these documents hold this very line, word for word, and it is long"
    rows = [(i, f"{rnd.random()} {line} {rnd.random()}") for i in range(200)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in suffix_dedup.op12_suffix_dedup(spark, str(tmp_path)).collect()}
    assert got[0].n_removed == 0 and all(got[i].n_removed >= len(line) for i in range(1, 200))
    assert sorted(map(tuple, got.values())) == brute_cut(rows)


def test_repeats_of_odd_rows(odd, ws):
    cut = {(r.doc_id, len(r.kept)) for r in suffix_dedup.without_repeats(odd, ws).collect()}
    assert {i for i, _ in cut} == {2, 4} and (2, 0) in cut  # upper case is another text; a null id neither loses nor takes
    assert suffix_dedup.without_repeats(odd.where("false"), ws).count() == 0


def test_multikey_order(monkeypatch):
    monkeypatch.setattr(suffixes, "SHORT", 4)
    rng = np.random.default_rng(0)
    keys = [rng.integers(0, 5, 500).astype(np.uint64) for _ in range(4)]
    order = suffixes.multikey_order(keys)
    assert sorted(order) == list(range(500)) and [tuple(k[i] for k in keys) for i in order] == sorted(zip(*keys))
    assert suffixes.multikey_order([np.zeros(0, np.uint64)]).size == 0


def test_every_window_lies_in_one_stretch_and_equal_windows_have_equal_anchors():
    texts = pa.array(["", "short", "y" * 50, " ".join(str(i * i) for i in range(3000)), "- " + " ".join(str(i * i) for i in range(500, 3000))])
    data, offsets = suffixes.utf8_of(texts)
    seen, words = set(), {}
    for s in suffixes.stretches(data, offsets):
        for row, start, n, word in zip(s.row.tolist(), s.start.tolist(), s.windows.tolist(), s.word.tolist()):
            for k in range(start, start + n):
                assert (row, k) not in seen
                seen.add((row, k))
                window = texts[row].as_py()[k : k + 50]
                assert len(window) == 50 and words.setdefault(window, word) == word
    assert len(seen) == sum(max(0, len(t.as_py()) - 49) for t in texts)


# ---- infilling


def brute_infill(doc_id, text, rate=100, first=50):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    h = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return doc_id, len(units), "plain", None, None, text
    spm = h4 % 100 < first
    return doc_id, len(units), "spm" if spm else "psm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}"


LINES = ["", "\n", "\n\n\n", "a", "a\n", "a\nb", "\na\n\nb\n", "é\n中\U0001f600\n", "x<P>\ny", "<S", "a <\nb<", "<<\n<M", "\r\n\r\n", "no\vfeed\x85here ", "end <M> end", None]


@pytest.mark.parametrize("rate,first,at_once", [(100, 50, 4 << 20), (60, 20, 16), (0, 50, 1)])
def test_infilling_is_that_of_plain_python(spark, monkeypatch, rate, first, at_once):
    monkeypatch.setattr(fill_middle, "AT_ONCE", at_once)
    rows = [(100 * k + i, t) for k in range(8) for i, t in enumerate(LINES)] + [(None, "a\nb\nc"), (7, "l\n" * 50_000)]
    got = fill_middle.fill_in_middle(spark.createDataFrame(rows, "doc_id long, text string"), rate=rate, suffix_first=first)
    back = got.select("*", fill_middle.restored(F.col("output"), F.col("form")).alias("back")).collect()
    assert sorted((tuple(r)[:-1] for r in back), key=str) == sorted((brute_infill(i, t, rate, first) for i, t in rows), key=str)
    assert sorted(r.back for r in back) == sorted(t or "" for _, t in rows)


def test_infilling_of_odd_rows(odd):
    got = fill_middle.fill_in_middle(odd)
    assert sorted(map(tuple, got.collect()), key=str) == sorted((brute_infill(r[0], r[1]) for r in odd_rows()), key=str)
    assert fill_middle.fill_in_middle(odd.where("false")).count() == 0
