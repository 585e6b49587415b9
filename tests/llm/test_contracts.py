"""The queries that SQL can't express, column by column against plain Python over whole tables."""

import hashlib
import os
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from attestra.llm.registry import QUERIES
from tests.compare import SF

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}


def ids_of(name, text, end):
    tokenizer = Tokenizer.from_file(public_tokenizers.path(name))
    tokenizer.encode_special_tokens = True
    return np.array([*tokenizer.encode(text, add_special_tokens=False).ids, end], "<u4")


def test_token_files(spark, docs):
    got = {r.doc_id: r for r in QUERIES["op3_token_files"](spark, SF).collect()}
    assert got.keys() == docs.keys()
    start = 0
    for i in sorted(docs):
        ids = ids_of("byte_bpe_50k.json", docs[i], 2)
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_packed_windows(spark, docs):
    rows = QUERIES["op6_packing"](spark, SF).collect()
    pieces, windows = {}, {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
        windows.setdefault(r.sequence_id, []).append(r)
    assert pieces.keys() == docs.keys()
    for i, parts in pieces.items():
        ids, at = ids_of("word_bpe_49k.json", docs[i], 1), 0
        for r in sorted(parts, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for parts in windows.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048


def luhn(digits):
    doubled = [int(c) * (1 + k % 2) for k, c in enumerate(reversed(digits))]
    return sum(d - 9 * (d > 9) for d in doubled) % 10 == 0


def spans_of(text):
    out = [("email", m) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", m) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", m) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 16 <= len(d := re.sub("[^0-9]", "", m[0])) <= 19 and luhn(d)]
    out += [("phone", m) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return [f"{k}:{m.start()}:{m.end()}" for k, m in out]


def test_personal_data(spark, docs):
    got = {r.doc_id: r for r in QUERIES["op4_personal_data"](spark, SF).collect()}
    assert got.keys() == docs.keys()
    for i, text in docs.items():
        spans, r = spans_of(text), got[i]
        kinds = Counter(s.split(":")[0] for s in spans)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(kinds[k] for k in ("email", "ip", "card", "phone"))
        assert r.base_sha256 == hashlib.sha256(",".join(spans).encode()).hexdigest() and r.spans.split(",")[: len(spans)] == (spans or [""])[: len(spans)]


def test_quality_rules(spark, docs):
    got = {r.doc_id: r for r in QUERIES["op5_quality_rules"](spark, SF).collect()}
    assert got.keys() == docs.keys()
    for i, text in docs.items():
        words, r = WORD.findall(text), got[i]
        lines = [x for x in text.split("\n") if WORD.search(x)]
        grams = Counter(zip(words, words[1:], words[2:]))
        repeated = {k + d for k, g in enumerate(zip(words, words[1:], words[2:])) if grams[g] > 1 for d in range(3)}
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(repeated))
        assert r.base_failed == (len(words) < 50 or 100 * len(repeated) > 50 * len(words)) and not (r.base_failed and r.kept)
