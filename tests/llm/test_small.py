"""Helpers of the operators, without Spark."""

import random
import re

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from attestra.llm import mixing, packing, pfor, privacy, quality_model, quality_rules, setsketch, words
from attestra.llm.encoding import Encoder

TEXT = st.text(alphabet=st.sampled_from("abcXYZäßé0123456789 \t\n\x0b@.+-()%_#*|é中'’\u2003"), max_size=80)


@settings(max_examples=300, deadline=None)
@given(TEXT)
def test_words_are_the_pattern_s(text):
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    wanted = re.findall(r"[^\x20\x09-\x0D]+", text.translate(fold))
    got = words.word_hashes(text.encode())
    assert len(got) == len(wanted)
    seen = {}
    assert all(seen.setdefault(w, h) == h for w, h in zip(wanted, got.tolist(), strict=True)) and len(set(seen.values())) == len(seen)


def test_long_texts_go_in_pieces():
    text = " ".join(f"w{i % 70001}" for i in range(300_000)).encode()
    assert len(text) > words._PIECE
    whole = words._piece(np.frombuffer(text, np.uint8), True)
    assert (words.word_hashes(text) == whole).all()


def test_short_sequences_are_one_shingle():
    assert len(words.shingle_set(b"one", 2)) == 1 and len(words.shingle_set(b" \n", 2)) == 0 and len(words.shingle_set(b"a b a b", 2)) == 2
    assert words.shingle_set(b"A b", 2).tolist() == words.shingle_set(b"a  B\n", 2).tolist()


def test_registers_merge_and_estimate():
    random_ = np.random.default_rng(1)
    universe = np.unique(random_.integers(0, 2**64, 3000, dtype=np.uint64))
    a, b = universe[:2000], universe[400:2400]
    s = setsketch.SetSketch()
    ra, rb, ru, empty = s.registers([a, b, np.union1d(a, b), a[:0]])
    assert (setsketch.SetSketch.merge(ra, rb) == ru).all() and not empty.any()
    j = setsketch.joint_estimate([2000], [2000], [(ra > rb).sum()], [(ra < rb).sum()], s.m)[0]
    assert abs(j - 1600 / 2400) < 0.12


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1), min_size=1, max_size=600))
def test_blocks_round_trip(values):
    v = np.array(values, np.uint32)
    assert (pfor.decode_block(pfor.encode_block(v)) == v).all()


def test_blocks_hold_outliers_apart():
    v = np.arange(4096, dtype=np.uint32) % 200 + 7
    v[::100] = 2**32 - 1
    assert len(pfor.encode_block(v)) < 4096 * 8 // 8 + 41 * 6 + 20 and (pfor.decode_block(pfor.encode_block(v)) == v).all()


def test_files_give_any_range(tmp_path):
    import pyarrow.fs as fs

    store, path = fs.LocalFileSystem(), str(tmp_path / "x.atpf")
    docs = [(i if i % 5 else None, np.random.default_rng(i).integers(0, 50000, n).astype(np.uint32)) for i, n in enumerate([3, 0, 5000, 1, 9000, 2])]
    w = pfor.Writer(store.open_output_stream(path))
    for d, ids in docs:
        w.add(d, ids)
    w.close()
    r = pfor.Reader(store.open_input_file(path))
    assert [(d, ids.tolist()) for d, _, ids in r.documents()] == [(d, ids.tolist()) for d, ids in docs]
    everything = np.concatenate([ids for _, ids in docs])
    assert all((r.range(a, n) == everything[a : a + n]).all() for a, n in ((0, 5), (4090, 20), (5000, 8000), (r.total, 0)))


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_is_the_library(name):
    library = Tokenizer.from_file(public_tokenizers.path(name))
    library.encode_special_tokens = True
    encoder = Encoder(public_tokenizers.path(name))

    @settings(max_examples=400, deadline=None)
    @given(TEXT)
    def check(text):
        assert next(encoder.encode([text])).tolist() == library.encode(text, add_special_tokens=False).ids

    check()
    texts = ["", None, "Hello, world. don't", "a\n\nb", "a\tb", " x ", "\x1cy", "p\x85q", "É<|endoftext|>ÿ", "it's 'S", "Straße.", "ab..", "é" * 300, "x" * 500 + ".", "1,2 3.", "日本 x", ",", "."]
    for texts in (texts, [], [None], ["w" * 9 + " ", "v"] * 3000 + ["u " * (1 << 22)]):
        found = [ids.tolist() for ids in encoder.encode(texts)]
        assert found == [library.encode(text or "", add_special_tokens=False).ids for text in texts]


def test_packing_covers_and_fits():
    random.seed(3)
    lengths = [random.randint(1, 512) for _ in range(700)]
    windows = packing.pack(lengths, 2048)
    assert sorted(i for w in windows for i in w) == list(range(700))
    sums = [sum(lengths[i] for i in w) for w in windows]
    assert max(sums) <= 2048 and 1 - sum(lengths) / (2048 * len(windows)) < 0.02 and max(sums) - min(sums) < 200
    assert packing.pack([], 10) == [] and packing.pack([10], 10) == [[0]] and len(packing.pack([6, 6, 6], 10)) == 3
    with pytest.raises(ValueError):
        packing.pack([11], 10)


def plain_spans(text):
    """The patterns as they stand."""
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()]
        if 16 <= len(d) <= 19 and sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(reversed(d))) % 10 == 0:
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


@settings(max_examples=2000, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab.@@--+%_01 ()25é\n"), max_size=60))
def test_spans_are_the_patterns(text):
    assert privacy.base_spans(text) == plain_spans(text)


def test_spans_by_example():
    text = "é a.b@c.de, 10.0.0.255 256.1.1.1 card 4111 1111 1111 1111 and +1 (499) 555-6503!"
    assert [(k, text[a:b]) for k, a, b in privacy.base_spans(text)] == [("email", "a.b@c.de"), ("ip", "10.0.0.255"), ("card", "4111 1111 1111 1111"), ("phone", "+1 (499) 555-6503")]
    assert privacy.base_spans("1" * 200_000 + "a" * 200_000 + "@") == []


def plain_statistics(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    hit = {j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(i, i + 3)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit)


@settings(max_examples=500, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab# é\n\r\t中"), max_size=60))
def test_statistics_are_the_plain_ones(text):
    assert quality_rules.text_statistics(text.encode()) == plain_statistics(text)


def test_classifier_learns_and_constants_stand():
    good, bad = [f"the {w} of a {w} thing goes on".encode() for w in "abcdefgh"], [f"{w}!! {w}!! {w}!! {w}$$$".encode() for w in "ABCDEFGH"]
    table, base = quality_model.scalar_table(quality_model.train([quality_model.bag(t) for t in good + bad], np.array([1] * 8 + [0] * 8)))
    assert quality_model.score(b"the x of a y thing", table, base) > 0.5 > quality_model.score(b"Z!! Z!! Z$$$", table, base)
    table, base = quality_model.scalar_table(quality_model.train([], np.array([])))
    assert quality_model.score(b"", table, base) == pytest.approx(0.5)
    many = quality_model.features(b"ab cd " * 60_000)
    assert len(many) > 600_000


def test_terms_cover_the_distribution():
    rate, p = mixing.TERM_RATE, np.exp(-mixing.TERM_RATE)
    total = p
    for k in range(1, mixing.TERMS):
        p *= rate / k
        total += p
    assert abs(1 - total) < 1e-12
