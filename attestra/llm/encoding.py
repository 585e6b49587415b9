"""Token ids by the tokenizers library, each distinct piece of text once.

Both public vocabularies cut a text at white space before any merge, so a text's ids are the ids of its pieces in
order. Texts are cut and their pieces numbered in Arrow, a batch at once; only distinct pieces are looked up, and only new
ones go through the library. Texts for which the cut isn't plainly the library's own (runs of white space, other space
characters, letters outside Latin-1) go through it whole.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Pieces kept by a worker before it starts afresh; bounds its memory to about 200 MB. Characters cut up at once.
KEPT, AT_ONCE = 800_000, 1 << 22
#: What isn't cut here: other white space, letters outside Latin-1, and where blanks count, two of them in a row.
_ODD = r"[\x1c-\x1f\x{85}\x{a0}]|[^\x{00}-\x{ff}]"
_SPACES = r"[\t\x0b-\x0d]|[ \n][ \n]|" + _ODD
_MADE: dict[str, "Encoder"] = {}


class Encoder:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.model = self.tokenizer.model
        self.by_word = self.tokenizer.normalizer is not None  # lower-cased words; else bytes, with the space before them
        self.kept: dict[str, bytes] = {"": b""}
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in printable]
        self.alphabet = {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(rest)}

    @classmethod
    def of(cls, path: str) -> "Encoder":
        """One for each worker process, so that later tasks find the pieces of earlier ones."""
        if path not in _MADE:
            _MADE[path] = cls(path)
        return _MADE[path]

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def _at(self, piece: str) -> bytes:
        ids = self.kept.get(piece)
        if ids is None:
            if piece[-1] in ",." and piece[:-1].lstrip(" ").isalpha():  # made of two units; kept as those
                return self._at(piece[:-1]) + self._at(piece[-1])
            if len(self.kept) >= KEPT:
                self.kept = {"": b""}
            if len(piece) < 200 and piece.lstrip(" ").isalpha():  # one run of letters is one unit of the model
                if piece.isascii():
                    piece_ = piece.replace(" ", self.alphabet[32])
                else:
                    piece_ = piece.encode().decode("latin-1").translate(self.alphabet)
                ids = array("I", [t.id for t in self.model.tokenize(piece_)]).tobytes()
            else:
                ids = self.whole(piece).tobytes()
            self.kept[piece] = ids
        return ids

    def _pieces(self, texts: list[str]) -> pa.ListArray:
        if self.by_word:
            return pc.ascii_split_whitespace(pa.array([t.lower() for t in texts], pa.large_string()))
        marked = pc.replace_substring(pa.array(texts, pa.large_string()), "\n", "\x1f\n\x1f")
        return pc.split_pattern(pc.replace_substring(marked, " ", "\x1f "), "\x1f")

    def _together(self, texts: list[str]) -> Iterator[np.ndarray]:
        lists = self._pieces(texts)
        numbered = lists.flatten().dictionary_encode()
        found = [self._at(p) for p in numbered.dictionary.to_numpy(zero_copy_only=False)]
        values, size = np.frombuffer(b"".join(found), np.uint32), np.fromiter(map(len, found), np.int64, len(found)) // 4
        which = numbered.indices.to_numpy()
        n = size[which]
        ends = np.concatenate([[0], np.cumsum(n)])
        place = np.concatenate([[0], np.cumsum(size)[:-1]])[which] if len(which) else which
        ids = values[np.arange(ends[-1]) + np.repeat(place - ends[:-1], n)]
        cuts = ends[lists.offsets.to_numpy() - lists.offsets[0].as_py()].tolist()
        for a, b in zip(cuts, cuts[1:]):
            yield ids[a:b]

    def encode(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        """The ids of each text, in order; null counts as empty."""
        at = 0
        while at < len(texts):
            to, chars = at, 0
            while to < len(texts) and (to == at or chars + len(texts[to] or "") <= AT_ONCE):
                chars += len(texts[to] or "")
                to += 1
            part = [t or "" for t in texts[at:to]]
            plain = pc.invert(pc.match_substring_regex(pa.array(part, pa.large_string()), _ODD if self.by_word else _SPACES)).to_pylist()
            together = self._together([t for t, p in zip(part, plain, strict=True) if p])
            for text, p in zip(part, plain, strict=True):
                yield next(together) if p else self.whole(text)
            at = to
