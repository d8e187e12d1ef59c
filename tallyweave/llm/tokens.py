"""Byte-level BPE ids of whole texts, a column at a time.

Texts are cut before each space; the distinct words of a batch are encoded once, and a memo keeps
words over batches. Cutting before single spaces between non-space characters leaves the ids as they
are: the pre-tokenizer's pattern never runs over such a place. Texts with any other space next to
white space are encoded whole, as are texts with a string of an added token, which is one id as the
vocabulary's file says.
"""

from __future__ import annotations

import base64
import json

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

TIKTOKEN_FILE = "byte_bpe_50k.tiktoken"
LIBRARY_FILE = "byte_bpe_50k.json"
_WHITE = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_RUNS = f"{_WHITE} {_WHITE}|  "


def vocabulary_path(name: str = TIKTOKEN_FILE) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def added_tokens(path: str) -> dict[str, int]:
    """Strings that the vocabulary's own file makes one id wherever they stand."""
    with open(path, encoding="utf-8") as f:
        return {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}


class Encoder:
    """Ids of whole columns of texts. The memo holds ``memo`` words at most, the work is done ``chunk`` bytes at a time.

    ``path`` names the ranks; ``added`` are the strings of one id, by default those of the same vocabulary's library file.
    """

    def __init__(self, path: str | None = None, memo: int = 300_000, chunk: int = 4 << 20, added: dict[str, int] | None = None):
        import public_tokenizers
        import tiktoken

        with open(path or vocabulary_path(), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self._added = added_tokens(vocabulary_path(LIBRARY_FILE)) if added is None else added
        self._bpe = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=self._added)
        self._memo, self._most, self._chunk = {}, memo, chunk
        self._spaced = np.zeros(1 + max(ranks.values()), bool)
        self._spaced[[n for b, n in ranks.items() if b.startswith(b" ")]] = True

    def _whole(self, text: str) -> bytes:
        return np.array(self._bpe.encode(text, allowed_special="all"), "<u4").tobytes()

    def _spaced_words(self, words: list[str]) -> list[bytes]:
        """Ids of each word after a space. One call for all: only a word's first id starts with a space."""
        found = list(map(self._memo.get, words))
        missed = [i for i, ids in enumerate(found) if ids is None]
        for at in range(0, len(missed), 4096):
            some = missed[at : at + 4096]
            # words that have white space at an end go alone, others cannot touch their neighbours
            safe = [i for i in some if words[i] and not (words[i][0].isspace() or words[i][-1].isspace())]
            ids = np.array(self._bpe.encode_ordinary("".join(f" {words[i]}" for i in safe)), "<u4")
            cuts = np.flatnonzero(self._spaced[ids]) * 4
            if len(cuts) == len(safe):
                whole, ends = ids.tobytes(), [*cuts[1:].tolist(), 4 * len(ids)]
                for i, a, b in zip(safe, cuts.tolist(), ends):
                    found[i] = whole[a:b]
            for i in some:
                if found[i] is None:
                    found[i] = self._whole(" " + words[i])
                if len(self._memo) < self._most and len(words[i]) < 40:
                    self._memo[words[i]] = found[i]
        return found

    def _chunk_ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids by text) of texts without nulls."""
        whole = pc.match_substring_regex(texts, _RUNS).to_numpy(zero_copy_only=False)
        for token in self._added:
            whole = whole | pc.match_substring(texts, token).to_numpy(zero_copy_only=False)
        split = pc.split_pattern(pc.if_else(pa.array(whole), "", texts), " ")
        starts = split.offsets.to_numpy()
        starts, words = starts - starts[0], split.flatten()
        coded = words.dictionary_encode()
        index = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        first_coded = words.take(pa.array(starts[:-1], pa.int64())).dictionary_encode()
        table = self._spaced_words(coded.dictionary.to_pylist())
        index[starts[:-1]] = first_coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) + len(table)
        table += [self._whole(w) for w in first_coded.dictionary.to_pylist()]
        for i in np.flatnonzero(whole):  # such a text counts as one word, the empty one
            index[starts[i]] = len(table)
            table.append(self._whole(texts[int(i)].as_py()))
        flat = np.frombuffer(b"".join(table), "<u4")
        size = np.fromiter(map(len, table), np.int64, len(table)) // 4
        begin = np.cumsum(size) - size
        n = size[index]
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        ids = flat[np.repeat(begin[index] - (ends - n), n) + np.arange(total)]
        bounds = np.concatenate([[0], ends])[starts]
        return ids, np.diff(bounds)

    def texts(self, column: pa.Array):
        """For each text, in order, its ids; null counts as empty."""
        column = pc.fill_null(column.cast(pa.large_string()), "")
        sizes = np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False)) // self._chunk
        edges = [0, *(np.flatnonzero(np.diff(sizes)) + 1).tolist(), len(column)]
        for a, b in zip(edges, edges[1:]):
            if a < b:
                ids, counts = self._chunk_ids(column[a:b])
                ends = np.cumsum(counts)
                for e, n in zip(ends.tolist(), counts.tolist()):
                    yield ids[e - n : e]

    def counts(self, column: pa.Array) -> np.ndarray:
        """For each text, the number of its ids; null counts as empty."""
        return np.fromiter(map(len, self.texts(column)), np.int64, len(column))


_ENCODERS: dict = {}


def encoder(path: str | None = None) -> Encoder:
    """One encoder for each vocabulary in a process."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
