"""Token ids of whole texts by a tokenizer file of the ``tokenizers`` library.

The library normalises and splits each text anew and so spends most of its
time on words it has met before.  :class:`TextEncoder` lets Arrow lower-case
and split a run of texts into pieces the same way, has the library's model
encode each distinct piece once, and expands the remembered ids with numpy.
Texts with characters for which the two ways of splitting might differ go
through the library as a whole.
"""

from __future__ import annotations

import os
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: The split pattern of the word-level vocabulary without its letter runs, which stand between these.
SPLIT = r"('s|'t|'re|'ve|'m|'ll|'d|\pN|[^\s\pL\pN]+)"
#: Any other character sends its text through the library.
UNSAFE = "[^\t\n\r -~¡-§«¬®-±´¶·»¿À-įĲ-ňŊ-ſ‘’“”–—…•€]|<\\|"
#: Distinct pieces remembered by a worker before it starts anew; a piece takes about 50 bytes.
MAX_PIECES = 300_000
#: Characters of text to encode at once: the more, the fewer pieces are looked up again.
RUN_CHARS = 2_000_000


def byte_alphabet() -> dict[int, str]:
    """Each byte's printable stand-in in byte-level vocabularies: itself where printable, else from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(0x100 + i) for i, b in enumerate(rest)}


class TextEncoder:
    """Encodes texts as one array of ids and the number of ids of each text."""

    def __init__(self, path: str, max_pieces: int = MAX_PIECES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.max_pieces = max_pieces
        self.alphabet = byte_alphabet()
        self.forget()

    def forget(self) -> None:
        """Forgets all pieces but the empty one."""
        self.known = pa.array([""], pa.string())
        self.flat, self.begins, self.counts = array("I"), array("q", [0]), array("q", [0])

    def learn(self, pieces: list[str]) -> None:
        """Has the model encode new pieces and remembers them."""
        tokenize, flat, spell = self.model.tokenize, self.flat, self.alphabet.__getitem__
        for piece in pieces:
            self.begins.append(len(flat))
            flat.extend([t.id for t in tokenize(piece if piece.isascii() else "".join(map(spell, piece.encode())))])
            self.counts.append(len(flat) - self.begins[-1])

    def _numbers(self, pieces: pa.Array) -> np.ndarray:
        """The numbers of distinct pieces among those known, new ones being learnt."""
        if len(self.known) > self.max_pieces:
            self.forget()
        found = pc.index_in(pieces, value_set=self.known)
        new = pieces.filter(pc.is_null(found))
        numbers = found.fill_null(-1).to_numpy().astype(np.int64)
        numbers[numbers < 0] = np.arange(len(self.known), len(self.known) + len(new))
        self.learn(new.to_pylist())
        self.known = pa.concat_arrays([self.known, new])
        return numbers

    def _encode_safe(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        spaced = pc.replace_substring_regex(pc.utf8_lower(texts), SPLIT, r" \1 ")
        pieces = pc.ascii_split_whitespace(spaced)
        coded = pc.list_flatten(pieces).dictionary_encode()
        numbers = self._numbers(coded.dictionary)
        # Views of the remembered ids end here, as the arrays can't grow while there are any.
        flat, begins, counts = np.array(self.flat, np.uint32), np.array(self.begins)[numbers], np.array(self.counts)[numbers]
        at = coded.indices.to_numpy()
        n = counts[at]
        ends = np.concatenate([[0], np.cumsum(n)])
        ids = flat[np.repeat(begins[at] - ends[:-1], n) + np.arange(int(ends[-1]))]
        return ids, np.diff(ends[pieces.offsets.to_numpy()])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in order (uint32) and the count of each text (int64)."""
        if not texts:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        column = pa.array(texts, pa.string())
        unsafe = pc.match_substring_regex(column, UNSAFE)
        rows = np.flatnonzero(unsafe.to_numpy(zero_copy_only=False)).tolist()
        if not rows:
            return self._encode_safe(column)
        # Runs of texts between those that the library encodes.
        parts, counts, first = [], [], 0
        for row in [*rows, len(texts)]:
            if row > first:
                ids, n = self._encode_safe(column.slice(first, row - first))
                parts.append(ids)
                counts.append(n)
            if row < len(texts):
                parts.append(np.array(self.tokenizer.encode(texts[row], add_special_tokens=False).ids, np.uint32))
                counts.append(np.array([len(parts[-1])], np.int64))
            first = row + 1
        return np.concatenate(parts), np.concatenate(counts)


def vocabulary_of(path: str) -> int:
    """One more than the largest id of a tokenizer file."""
    from tokenizers import Tokenizer

    return max(Tokenizer.from_file(path).get_vocab(with_added_tokens=True).values(), default=-1) + 1


_ENCODERS: dict[str, TextEncoder] = {}


def encoder(path: str) -> TextEncoder:
    """The worker's encoder for a tokenizer file; Python workers are reused by later tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = TextEncoder(path)
    return _ENCODERS[path]
