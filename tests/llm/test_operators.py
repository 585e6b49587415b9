"""The operators on small tables: brute force, and rows that are null, empty, long, tied or repeated."""

import hashlib
import itertools
import re
import zlib

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from attestra.llm import exact_dup, mixing, near_dup, packing, privacy, quality_model, quality_rules, token_files, tool_calls, url_filters
from attestra.llm.components import components
from attestra.llm.shared import Workspace

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = ("kept", "component", "digest", "file", "row", "doc", "copies", "copy", "registers", "group", "x", "mean", "near", "term", "tie", "mixed", "shuffle_key", "score")


def odd_rows():
    base = " ".join(f"word{i}" for i in range(60))
    return [
        (1, base, "en", "a"), (2, base, "en", "a"), (2, base, "en", "a"), (3, base.upper(), "en", "a"), (4, base + " tail", None, None), (5, None, "en", "b"), (6, "", "en", "b"), (7, " \n\t", None, "b"),
        (None, base, "en", "c"), (None, None, None, None), (8, "one", "en", "c"), (9, "one", "en", "c"), (10, "long " + " ".join(f"x{i % 977}y" for i in range(60_000)), "en", "c"), (11, "É ß 中 \U0001f600 a@b.co", "de", "c"),
    ]


@pytest.fixture(scope="module")
def odd(spark):
    df = spark.createDataFrame([(*r, len(r[1] or "")) for r in odd_rows()], COLUMNS)
    return df.select("*", *(F.lit(1).alias(c) for c in CLASH))


@pytest.fixture(scope="module")
def none(odd):
    return odd.where("false")


@pytest.fixture
def ws(spark):
    return Workspace(spark)


def brute_groups(texts, size, percent=80):
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for i, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(fold))
        sets[i] = {tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set()
    root = {i: i for i in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(texts), 2):
        both = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: (len(sets[i]), find(i)) for i in texts}


@pytest.mark.parametrize("size", [2, 5])
def test_near_duplicates_are_those_of_brute_force(spark, ws, size):
    random = np.random.default_rng(size)
    texts, n = {}, 0
    for _ in range(12):
        words = [f"w{x}" for x in random.integers(0, 400, random.integers(3, 120))]
        for _ in range(int(random.integers(1, 14))):
            copy = list(words)
            for i in random.choice(len(copy), int(random.integers(0, max(2, len(copy) // 8))), replace=False):
                copy[i] = f"v{random.integers(0, 9)}"
            texts[n] = " ".join(copy)
            n += 1
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dup.near_duplicates(docs, ws, size).collect()}
    assert got == brute_groups(texts, size)


def test_blocks_find_links_that_leaders_miss(spark, ws, monkeypatch):
    """A chain: each text is linked with its neighbours alone, so most links aren't with a bucket's smallest id."""
    monkeypatch.setattr(near_dup, "BLOCK_SHINGLES", 2000)
    words = [f"w{i}" for i in range(400)]
    texts = {99 - k: " ".join(words[8 * k : 8 * k + 90]) for k in range(30)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dup.near_duplicates(docs, ws, 2).collect()}
    assert got == brute_groups(texts, 2) and len({c for _, c in got.values()}) == 1


def test_near_duplicates_of_odd_rows(odd, none, ws):
    got = {(r.doc_id, r.n_shingles): r for r in near_dup.near_duplicates(odd, ws, 2).collect()}
    assert {k[0]: r.component_id for k, r in got.items() if k[0]} == {1: 1, 2: 1, 3: 1, 4: 1, 5: 5, 6: 6, 7: 7, 8: 8, 9: 8, 10: 10, 11: 11}
    assert all(r.component_id is None and r.kept for k, r in got.items() if k[0] is None) and near_dup.near_duplicates(odd, ws, 2).count() == odd.count()
    assert near_dup.near_duplicates(none, ws).count() == 0


def test_components_of_paths_and_stars(spark, ws):
    edges = [(i, i + 1) for i in range(100, 140)] + [(7, i) for i in range(50, 80)] + [(3, 7), (90, 91), (91, 90)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long"), ws).collect()}
    assert got == {**{i: 100 for i in range(101, 141)}, **{i: 3 for i in range(50, 80)}, 7: 3, 91: 90}


def brute_exact(rows):
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    norm = [(r[0], (r[1] or "").translate(fold)) for r in rows]
    out = []
    for i, t in norm:
        ids = [j for j, u in norm if u == t]
        out.append((i, max((j for j in ids if j is not None), default=None), len(ids), hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=repr)


def weak(text):
    return F.unhex(F.sha2(F.substring(text, 1, 1), 256))


@pytest.mark.parametrize("digest", [exact_dup.sha256_digest, weak])
def test_exact_duplicates_also_with_a_digest_that_collides(odd, none, ws, digest):
    rows = exact_dup.exact_duplicates(odd, ws, digest)[0].collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in rows), key=repr) == brute_exact(odd_rows())
    by_text = {}
    for r in rows:
        by_text.setdefault(r.text_sha256, []).append(r)
    assert all(sum(r.kept for r in g) == 1 and next(r for r in g if r.kept).doc_id == g[0].keep_id for g in by_text.values())
    assert exact_dup.exact_duplicates(none, ws, digest)[0].count() == 0


def test_state_goes_on_where_it_ended(spark, ws):
    log, state, out = ws.folder("log"), ws.folder("state"), ws.folder("out")
    row = lambda i, t: (i, t.encode(), t, 1, i)
    spark.createDataFrame([row(1, "a"), row(2, "b")], exact_dup.LOG).write.parquet(log)
    exact_dup.advance(spark, log, state, out)
    spark.createDataFrame([row(3, "a")], exact_dup.LOG).write.mode("append").parquet(log)
    exact_dup.advance(spark, log, state, out)
    assert {(bytes(r.digest), r.n, r.keep.doc_id) for r in exact_dup._groups(spark, out).collect()} == {(b"a", 2, 3), (b"b", 1, 2)}


def test_one_copy_stays_with_all_columns(odd, ws):
    kept = exact_dup.without_copies(odd, ws)
    assert kept.columns == odd.columns and kept.count() == len({r[3] for r in brute_exact(odd_rows())})


def encoded(name, text, end):
    t = Tokenizer.from_file(public_tokenizers.path(name))
    t.encode_special_tokens = True
    return [*t.encode(text or "", add_special_tokens=False).ids, end]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_token_files_round_trip(odd, none, ws):
    folder = ws.folder("files")
    manifest = ws.keep(token_files.write_token_files(odd.repartition(3), folder, public_tokenizers.path("byte_bpe_50k.json"), 2), "manifest")
    got = sorted(token_files.read_token_files(manifest, folder).collect(), key=lambda r: r.start)
    ids = {r[0:2]: encoded("byte_bpe_50k.json", r[1], 2) for r in odd_rows()}
    assert sorted(((r.doc_id, r.n_tokens, r.ids_crc32) for r in got), key=repr) == sorted(((r[0], len(ids[r[0:2]]), crc(ids[r[0:2]])) for r in odd_rows()), key=repr)
    assert [r.start for r in got] == [0, *itertools.accumulate(r.n_tokens for r in got)][:-1]
    known = [r.doc_id for r in got if r.doc_id is not None]
    assert known == sorted(known)
    folder = ws.folder("files")
    assert token_files.read_token_files(ws.keep(token_files.write_token_files(none, folder, public_tokenizers.path("byte_bpe_50k.json"), 2), "m"), folder).count() == 0


def test_packed_pieces_hold_all_ids_once(odd, none, ws):
    rows = ws.keep(packing.packed(odd, ws), "packed").toPandas()
    per_text = {}
    for r in odd_rows():
        per_text[r[0:2]] = encoded("word_bpe_49k.json", r[1], 1)
    pieces = sorted((len(v), i, crc(v)) for v in per_text.values() for i in (0,) if len(v) <= 512)
    small = rows[rows.doc_tokens <= 512]
    assert set(pieces) == set(zip(small.doc_tokens, small.start, small.ids_crc32, strict=True))
    long = per_text[next(r[0:2] for r in odd_rows() if r[0] == 10)]
    assert all(crc(long[s : s + n]) == c for s, n, c in rows[rows.doc_id == 10][["start", "length", "ids_crc32"]].itertuples(index=False))
    assert rows.length.sum() == sum(len(per_text[r[0:2]]) for r in odd_rows())
    seqs = rows.sort_values("offset").groupby("sequence_id")
    assert all(list(g.offset) == [0, *g.length.cumsum()][:-1] and g.length.sum() <= 2048 for _, g in seqs)
    assert packing.packed(none, ws).count() == 0


def test_mixing_reaches_its_weights(spark, odd, none, ws):
    docs = spark.createDataFrame([(i, "x" * (10 + i % 7), "en", "big" if i % 10 else "small", 0) for i in range(6000)], COLUMNS)
    out = mixing.mixed(docs, ws, {"big": 1.0, "small": 1.0}, epochs=2.0)
    mass = {r.source: r.m for r in out.groupBy("doc.source").agg(F.sum(F.length("doc.text")).alias("m")).collect()}
    total = 2 * docs.agg(F.sum(F.length("text"))).first()[0]
    assert abs(mass["small"] / total - 0.5) < 0.03 and abs(mass["big"] / total - 0.5) < 0.03
    copies = out.where("doc.source = 'small'").groupBy("doc.doc_id").count().toPandas()["count"]
    assert copies.mean() == pytest.approx(10, abs=0.5) and copies.var() == pytest.approx(10, abs=2)  # as a Poisson number's
    keys = [r[0] for r in out.select("shuffle_key").collect()]
    assert keys == sorted(keys)
    assert out.exceptAll(mixing.mixed(docs, ws, {"big": 1.0, "small": 1.0}, epochs=2.0)).count() == 0
    many = mixing.mixed(odd, ws, epochs=200.0)
    assert many.select("doc.*").columns == odd.columns and {r[0] for r in many.select("doc.source").distinct().collect()} >= {"a", "b", "c"} - {"b"}
    assert mixing.mixed(none, ws).count() == 0


def test_disclosing_terms(spark, none, odd, ws):
    texts = [f"filler{i} some words here again and again" for i in range(60)]
    texts += [f"the zorblax project of alice@corp.example ran {i}" for i in range(3)] + ["zorblax is not named elsewhere", "some words bob@corp.example here"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in privacy.personal_data(docs, ws).collect()}
    assert len(got) == len(texts) and not got[0].base and not got[0].terms and not got[63].terms and not got[64].terms
    assert {texts[60][s.start : s.stop] for s in got[60].terms} == {"the", "zorblax", "project", "of", "ran"}
    clean = privacy.personal_data(docs, ws).join(docs, "doc_id").select("doc_id", privacy.sanitised(F.col("text"), F.col("base"), F.col("terms")).alias("t"))
    out = {r.doc_id: r.t for r in clean.collect()}
    assert "alice" not in out[60] and "zorblax" not in out[60] and "<email>" in out[60] and out[0] == texts[0]
    assert privacy.personal_data(odd, ws).count() == odd.count() and privacy.personal_data(none, ws).count() == 0


def test_sanitised_texts_are_in_the_result(spark, ws):
    texts = [f"filler{i} some words here" for i in range(40)] + [f"call +49 30 1234567 Zorblax x9 77 copy{i}" for i in range(2)]
    got = {r.doc_id: r for r in privacy.personal_data(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), ws).collect()}
    assert got[0].sanitised is None and got[40].sanitised.replace("copy0", "copy1") == got[41].sanitised and "<phone>" in got[40].sanitised and "Zorblax" not in got[40].sanitised
    assert [privacy.general_form(w) for w in ("Paris", "lab", "x9", "77", "")] == ["<name>", "<word>", "<code>", "<number>", "<word>"]


def test_disclosing_terms_of_whole_documents(spark, ws):
    """Far from the mention, behind a long word, and each time they stand in its documents."""
    texts = [f"filler{i} some words here again and again" for i in range(60)]
    texts += [f"carol@corp.example {'again ' * 40}{'x' * 300} Zorblax and {'words ' * 40}zorblax {i}" for i in range(2)] + ["some zorblaxes"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: [(texts[r.doc_id][s.start : s.stop], s.share) for s in r.terms] for r in privacy.personal_data(docs, ws).collect()}
    assert got[60] == got[61] == [("x" * 300, 1.0), ("Zorblax", 1.0), ("zorblax", 1.0)] and not any(t for i, t in got.items() if i not in (60, 61))


def brute_disclosing(texts):
    mentions = {i: {(k, t[a:b].lower()) for k, a, b in privacy.base_spans(t)} for i, t in texts.items()}
    words = {i: {w.lower() for w in re.findall(r"[^\x20\x09-\x0D]+", t)} for i, t in texts.items()}
    out = {i: set() for i in texts}
    for e in set().union(*mentions.values()):
        have = [i for i in texts if e in mentions[i]]
        for w in set().union(*(words[i] for i in have)) if len(have) < len(texts) else ():
            both, df = sum(w in words[i] for i in have), sum(w in words[i] for i in texts)
            if both >= 2 and np.log(len(texts) * both / (len(have) * df)) / np.log(len(texts) / len(have)) >= privacy.GENERALISE:
                for i in have:
                    out[i] |= {m.span() for m in re.finditer(r"[^\x20\x09-\x0D]+", texts[i]) if m[0].lower() == w and not any(a < m.end() and m.start() < b for _, a, b in privacy.base_spans(texts[i]))}
    return out


def test_disclosing_terms_are_those_of_brute_force(spark, ws):
    random = np.random.default_rng(6)
    texts = {}
    for i in range(120):
        words = [f"w{int(x)}" for x in random.zipf(1.3, 40) if x < 500] + [f"p{x}@q.example" for x in random.integers(0, 12, int(random.integers(0, 4)))] + [f"10.0.0.{i % 2}"] * int(i % 3 > 0)
        texts[i] = " ".join(random.permutation(words))
    alone = brute_disclosing(texts)
    copies = {200 + k: texts[i] for k, i in enumerate((3, 3, 3, 7, 50, 51, 52))}  # these support nothing, and are treated as what they are copies of
    docs = spark.createDataFrame(list((texts | copies).items()), "doc_id long, text string").repartition(3)
    got = {r.doc_id: {(s.start, s.stop) for s in r.terms} for r in privacy.personal_data(docs, ws).collect()}
    assert got == alone | {i: alone[next(k for k, t in texts.items() if t == text)] for i, text in copies.items()} and sum(map(len, alone.values())) > 20


def test_copies_of_a_mention_disclose_nothing(spark, ws):
    texts = [f"filler{i} some words here" for i in range(40)] + ["rare words around dora@corp.example stand here"] * 5
    got = privacy.personal_data(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), ws).collect()
    assert len(got) == 45 and not any(r.terms for r in got) and sum(len(r.base) for r in got) == 5


def plain_estimate(x):
    """The estimate of one group on one array: the same definition, without Spark."""
    floor, dim, n = np.square(quality_rules.FLOOR), quality_rules.DIM, len(x)
    step = lambda d: np.floor(np.log(np.maximum(d, 1e-6)) * quality_rules.DISTANCE_STEPS)
    far = lambda x, mean, inverse: np.einsum("ij,jk,ik->i", x - mean, inverse, x - mean)
    grid = np.sort(np.floor(x * quality_rules.VALUE_STEPS) / quality_rules.VALUE_STEPS, axis=0)
    half = int(np.ceil(n / 2)) - 1
    middle = grid[half]
    scale = np.sqrt(np.square(1.4826 * np.sort(np.abs(grid - middle), axis=0)[half]) + floor)
    z = (x - middle) / scale
    norm = np.maximum((z * z).sum(1), 1e-6)
    near = z[step(norm) <= np.sort(step(norm))[int(np.ceil(0.5 * n)) - 1]]
    starts = [np.eye(dim)]
    for v in (np.tanh(z), z / np.sqrt(norm)[:, None], near):
        second = v.T @ v / len(v)
        deviation = np.sqrt(np.diag(second) + 1e-9)
        starts.append(0.999 * second / np.outer(deviation, deviation) + 0.001 * np.eye(dim))

    def concentrate(model):
        mean, inverse, size, falling = model
        if not falling:
            return model
        d = step(far(x, mean, inverse))
        inside = x[d <= np.sort(d)[int(np.ceil(quality_rules.SHARE * n)) - 1]]
        mean_ = inside.mean(0)
        cov = quality_rules.consistency(len(inside) / n) * (inside.T @ inside / len(inside) - np.outer(mean_, mean_)) + np.diag(floor)
        size_ = np.linalg.slogdet(cov)[1]
        return (mean_, np.linalg.inv(cov), size_, True) if size_ < size - 1e-6 else (mean, inverse, size, False)

    models = [(middle, np.linalg.inv(s * np.outer(scale, scale)), np.inf, True) for s in starts]
    for _ in range(quality_rules.FIRST_STEPS):
        models = [concentrate(m) for m in models]
    best = (*min(models, key=lambda m: m[2])[:3], True)
    for _ in range(quality_rules.MOST_STEPS):
        best = concentrate(best)
    inside = x[far(x, *best[:2]) <= quality_rules.NEAR]
    mean = inside.mean(0)
    factor = quality_rules.REWEIGHT / quality_rules.chi2_cdf(quality_rules.NEAR, dim + 2)
    return n, mean, factor * (inside.T @ inside / len(inside) - np.outer(mean, mean)) + np.diag(floor)


def plain_distances(rows):
    """Distance by id for rows ``(doc_id, text, lang, source)`` that pass the base rule."""
    x, group = {}, {}
    for i, text, lang, source, *_ in rows:
        n, chars, symbols, lines, repeats = quality_rules.text_statistics((text or "").encode())
        if n >= 50 and 2 * repeats <= n:
            x[i] = [np.log1p(n), np.log((chars + 250) / (n + 50)), *(np.sqrt(v / n) for v in (symbols, lines, repeats))]
            group[i] = [(), (lang,), (lang, source)]
    made = {g: plain_estimate(np.array([x[i] for i in x if g in group[i]])) for g in {g for gs in group.values() for g in gs}}
    out = {}
    for i in x:
        mean = cov = None
        for n, m, c in (made[g] for g in group[i]):
            part = 1.0 if mean is None else n / (n + quality_rules.PARENT_ROWS)
            mean, cov = (m, c) if mean is None else (part * m + (1 - part) * mean, part * c + (1 - part) * cov)
        out[i] = (np.array(x[i]) - mean) @ np.linalg.inv(cov) @ (np.array(x[i]) - mean)
    return out


def test_distances_are_those_of_a_plain_estimate(spark, ws):
    random = np.random.default_rng(11)
    rows = []
    for i in range(330):
        words = ["".join(random.choice(list("abcdefghij"), int(random.integers(2, 5 + i % 7)))) + random.choice(["", "", "", "#", "*"]) for _ in range(int(random.integers(45, 400)))]
        text = " ".join(words[:30] + words[: int(random.integers(0, 40))] + words[30:])
        rows.append((i, text, ["en", "de", None][i % 3], ["a", "b", "c", None][int(random.integers(0, 4)) if i % 3 else 0], 0))
    rows += [(1000 + i, " ".join("xyz"[j % 3] + "$$$" + str(j % 50) for j in range(200)), "en", "a", 0) for i in range(4)] + [(2000, "lone " + " ".join(f"w{j}" for j in range(80)), "fr", "z", 0)]
    got = {r.doc_id: r for r in quality_rules.judged(spark.createDataFrame(rows, COLUMNS).repartition(5), ws).collect()}
    want = plain_distances(rows)
    assert {i for i, r in got.items() if r.distance is not None} == set(want)
    assert all(abs(got[i].distance - d) <= 1e-6 * (1 + d) for i, d in want.items())
    assert all(got[i].kept == (i in want and want[i] <= quality_rules.CUT) for i in got) and not any(got[1000 + i].kept for i in range(4))
    again = {r.doc_id: r.kept for r in quality_rules.judged(spark.createDataFrame(rows[::-1] + rows[:1], COLUMNS).repartition(2), ws).collect()}
    assert set(again) == set(got)


def test_chi_squared():
    for p, k, q in ((0.999, 5, 20.515), (0.975, 5, 12.833), (0.5, 5, 4.351), (0.95, 1, 3.841)):
        assert quality_rules.chi2_quantile(p, k) == pytest.approx(q, abs=1e-3)


def test_outliers_go_and_the_bulk_stays(spark, odd, none, ws):
    random = np.random.default_rng(4)
    rows = [(i, "\n".join(" ".join("".join(random.choice(list("abcdefgh"), int(random.integers(2, 9)))) for _ in range(12)) for _ in range(int(random.integers(6, 30)))), "en", "s", 0) for i in range(400)]
    rows += [(1000 + i, " ".join(f"{a}***" for a in random.choice(list("abcdefgh"), 300)), "en", "s", 0) for i in range(5)]
    got = quality_rules.judged(spark.createDataFrame(rows, COLUMNS), ws).toPandas()
    assert got[got.doc_id < 1000].kept.mean() > 0.995 and not got[got.doc_id >= 1000].kept.any()
    strange = {r.doc_id: r for r in quality_rules.judged(odd, ws).collect() if r.doc_id}
    assert strange[1].kept and not strange[5].kept and strange[5].n_words == 0 and not strange[8].kept
    assert quality_rules.judged(none, ws).count() == 0


def test_classifier_on_odd_rows(spark, odd, none, ws):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (5, 1, 0), (8, 1, 0), (9, None, 0), (None, 1, 0), (9, 7, 0), (8, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality_model.classified(odd, labels, ws).toPandas()
    assert len(got) == odd.count() and got.score.between(0, 1).all() and ((got.score >= 0.5) == (got.predicted == 1)).all()
    assert {r.doc_id for r in got.itertuples() if r.held_out} == {i for i in range(1, 12) if zlib.crc32(str(i).encode()) % 3 == 1}
    assert quality_model.classified(none, labels, ws).count() == 0
    assert set(quality_model.classified(odd, labels.where("false"), ws).toPandas().score.round(6)) == {0.5}


def test_labels_of_both_kinds_are_left_out(spark, ws):
    docs = spark.createDataFrame([(i, "good plain words here" if i % 2 else "### $$$ bad", "en", "s", 0) for i in range(40)], COLUMNS)
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    alone = quality_model.classified(docs, labels, ws).orderBy("doc_id").collect()
    turned = labels.where("doc_id < 6").withColumn("quality", 1 - F.col("quality"))
    assert quality_model.classified(docs, labels.unionByName(turned), ws).orderBy("doc_id").collect() == quality_model.classified(docs, labels.where("doc_id >= 6"), ws).orderBy("doc_id").collect()
    assert set(quality_model.classified(docs, labels.unionByName(labels.withColumn("quality", 1 - F.col("quality"))), ws).toPandas().score.round(6)) == {0.5}
    assert all((r.score >= 0.5) == bool(r.doc_id % 2) for r in alone)


def test_near_copies_go_by_row_where_ids_repeat(spark, ws):
    a, b, c = (" ".join(f"{k}{i}" for i in range(60)) for k in "abc")
    rows = [(1, a), (2, a + " more"), (2, b), (3, c), (3, c), (None, a), (4, a + " other"), (5, None), (5, None)]
    docs = spark.createDataFrame([(*r, "en", "s", 0) for r in rows], COLUMNS).withColumn("kept", F.lit("x"))
    left = near_dup.without_near_copies(docs, ws)
    assert left.columns == docs.columns
    got = sorted(((r.doc_id, r.text) for r in left.collect()), key=str)
    assert got == sorted([(1, a), (2, b), (3, c), (None, a), (5, None), (5, None)], key=str)
    once = docs.dropDuplicates(["doc_id"]).where("doc_id <> 2")
    assert sorted(r.doc_id for r in near_dup.without_near_copies(once, ws).where("doc_id is not null").collect()) == [1, 3, 5]


def test_rules_and_hosts(spark, ws):
    urls = ["https://A.Example.com/en/712?x", "http://example.com/en/8", "https://x.net/de/5", "https://b.example.net/de/81", "https://q.org/es/", "https://q.org/fr/1", None, "no scheme/en/", "x://com/en/", "https://notexample.com#/en/", "https://h?y", "a://b://com/en/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("host", F.lit(1)).withColumn("verdict", F.lit(1)).withColumn("s1", F.lit(1))
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filters.filtered(pages, ws).collect()}
    assert got[0] == ("a.example.com", "/en/712", "example.com/en/7", "allow") and got[1] == ("example.com", "/en/8", "com/en/", "block") and got[2][2:] == ("net/de/", "allow")
    assert got[3][2:] == ("example.net/de/8", "block") and got[4][2:] == ("org/es/", "block") and got[5] == ("q.org", "/fr/1", None, "allow")
    assert got[6] == ("", "", None, "allow") and got[7] == ("", "", None, "allow") and got[8][2:] == ("com/en/", "block") and got[9] == ("notexample.com", "", None, "allow") and got[10] == ("h", "", None, "allow") and got[11] == ("b:", "//com/en/", None, "allow")
    assert url_filters.filtered(pages.where("false"), ws).count() == 0
    many = tuple(url_filters.Rule("block", f"h{i}.test", "/x") for i in range(url_filters.LITERAL_RULES)) + url_filters.RULES  # joined by host
    assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filters.filtered(pages, ws, many).collect()} == got


def test_templates_go_down_all_levels(spark, ws):
    """Variable segments deep down become wildcards; what a branch is known for goes to branches that look like it."""
    names = [f"n{chr(97 + i)}{chr(97 + j)}" for i in range(6) for j in range(6)]
    urls = [f"https://h.test/{top}/deep/er/{name}/{last}" for top in ("a", "b") for name in names for last in ("view", "edit")]
    urls += [f"https://h.test/other/{name}.css" for name in names] + ["https://h.test/" + "s/" * 3000] * 3 + ["https://h.test/" + "s/" * 3000 + "t"] * 3
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").repartition(3)
    host, path = url_filters.host_and_path(F.col("url"))
    rows = pages.select(host.alias("host"), path.alias("path"), F.when(path.startswith("/a/"), "block").when(path.startswith("/other/"), "allow").alias("verdict"))
    got = {r.raw: (r.template, r.purity) for r in url_filters.templates(rows, ws).collect()}
    assert got["/a/deep/er/naa/view"] == got["/b/deep/er/nff/view"] and got["/b/deep/er/nab/edit"][0] == "/{a}/deep/er/*/{edit}"
    assert got["/b/deep/er/nff/view"][1] >= url_filters.PURITY and got["/other/naa.css"] == (got["/other/nab.css"][0], got["/other/nab.css"][1]) and got["/other/naa.css"][1] < 0.5
    verdicts = url_filters.filtered(pages, ws, (url_filters.Rule("block", "h.test", "/a/"), url_filters.Rule("allow", "h.test", "/other/"))).toPandas()
    assert len(verdicts) == len(urls) and set(verdicts[verdicts.path.str.startswith("/b/")].verdict) == {"block"} and verdicts.rule.isna().sum() == 72 + 6


def test_deep_paths_take_few_rounds(spark):
    """Pages a thousand segments deep, which part near the root and at the end."""
    deep = "/".join(f"s{i % 7}x" for i in range(1000))
    urls = [f"http://h.com/{k}/{deep}/{x}" for k in ("en", "de") for x in "abcdefghij"] + [f"http://h.com/{deep}"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    ws = Workspace(spark)
    rules = (url_filters.Rule("block", "h.com", "/en/"),)
    got = {r.page_id: r.verdict for r in url_filters.filtered(pages, ws, rules).collect()}
    assert ws._n < 80 and all(got[i] == "block" for i in range(10)) and set(got.values()) <= {"allow", "block"}


def test_templates_carry_labels_over(spark, ws):
    rules = (url_filters.Rule("block", "shop.test", "/item/1"), url_filters.Rule("allow", "shop.test", "/help/1"))
    urls = [f"https://shop.test/item/{n}" for n in (11, 12, 13, 14, 25)] + [f"https://shop.test/help/{n}" for n in (11, 12, 13, 14, 25)] + ["https://shop.test/about"]
    got = {r.path: (r.rule, r.verdict) for r in url_filters.filtered(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), ws, rules).collect()}
    assert got["/item/25"] == (None, "block") and got["/help/25"] == (None, "allow") and got["/about"] == (None, "allow")


def test_tool_calls(spark, ws):
    m = [
        (1, 0, "user", "call", "b", "ask", None, '{"turn": 1, "prompt": "x"}', None), (1, 1, "assistant", "result", "b", None, None, None, "fine"), (1, 2, "user", "call", "a", "follow_up", "b", '{"prompt":"y","turn":2}', None),
        (1, 3, "assistant", "result", "a", None, None, None, "ok"), (1, 4, "assistant", "result", "a", None, None, None, "again"), (1, 5, "assistant", "result", "zz", None, None, None, "lost"), (1, 6, "user", "call", "c", "ask", None, "not json", None),
        (1, 7, "user", "call", "p", "ask", "q", '{"prompt":7,"turn":1}', None), (1, 8, "user", "call", "q", "nope", "p", "{}", None), (1, 9, "system", "text", None, None, None, None, None), (None, None, None, "call", None, None, None, None, None),
    ]
    df = spark.createDataFrame(m, "conv_id long, turn long, role string, kind string, call_id string, name string, after string, arguments string, content string")
    got = {r.turn: r for r in tool_calls.linked(df, ws).collect()}
    assert [(got[t].status, got[t].position) for t in range(7)] == [("linked", 0), ("linked", 1), ("linked", 2), ("linked", 3), ("duplicate", 3), ("orphan", -1), ("pending", 0)]
    assert got[0].error is None and got[2].error == "after: missing" and got[6].error == "not an object" and got[7].error == got[8].error == "circular"
    assert got[0].message_json == '{"arguments":{"prompt":"x","turn":1},"call_id":"b","kind":"call","name":"ask"}'
    assert got[9].message_json == '{"content":"","kind":"text","role":"system"}' and got[None].status == "pending"
    assert tool_calls.linked(df.where("false"), ws).count() == 0
    clash = df.select("*", *(F.lit(1).alias(c) for c in ("level", "result", "call", "mine", "status", "position", "known", "up", "id", "next")))
    assert sorted(map(str, tool_calls.linked(clash, ws).collect())) == sorted(map(str, got_all := tool_calls.linked(df, ws).collect())) and len(got_all) == len(m)
    nameless = df.withColumn("kind", F.lit(None).cast("string"))
    assert {r.status for r in tool_calls.linked(nameless, ws).collect()} == {"text"}


def test_long_chains_and_repeated_rows(spark, ws):
    chain = spark.createDataFrame([(f"c{i}", f"c{i - 1}" if i else None) for i in range(70)], "call_id string, after string")
    assert {r.call_id: r.level for r in tool_calls.call_levels(chain, ws).collect()} == {f"c{i}": i for i in range(70)}
    conv = spark.createDataFrame([(1, 0, "user", "hi")] * 50 + [(1, 1, "assistant", "yes")] * 50 + [(None, None, None, None), (2, 0, "user", None)], "conv_id long, turn long, role string, text string").withColumn("status", F.lit(1))
    got = tool_calls.linked(tool_calls.conversation_messages(conv), ws)
    assert got.count() == 102 and got.where("status = 'linked'").count() == 100


def test_pipeline_stages(spark, odd, tmp_path):
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 0), (10, 1, 0)], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    odd.write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:4]:
        docs = Workspace(spark).keep(stage(spark, docs, str(tmp_path)), name)
        assert docs.columns == odd.columns
    near = corpus_pipeline.near(spark, corpus_pipeline.exact(spark, odd, ""), "")
    assert {r.doc_id for r in near.collect()} >= {3, 9, 10, 11} and near.where("doc_id = 4").count() == 0
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "exact", "near", "mix", "pack"] and corpus_pipeline.ORACLE_SQL is None


def test_pipeline_of_nothing(spark, none, tmp_path):
    none.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    assert pd.DataFrame(corpus_pipeline.STAGES).shape == (5, 2)
