"""Token ids of whole texts by a public word-level tokenizer, each distinct word encoded once in a while.

The tokenizer drops white space and no token spans it, so a text's ids are those of its words in
order. Words are found and hashed for a run of texts at once; a table of fixed size remembers the
ids of words met before, and a word that another one displaced is simply encoded again.
"""

from __future__ import annotations

import os

import numpy as np

from .common import words_of

_CHUNK = 1 << 20
#: ASCII signs that form one pre-token when they follow each other; the apostrophe may begin another.
_SIGNS = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum() and chr(c) != "'")
_WORD_END = "</w>"
_JOINED = 200


class WordTokens:
    """Encodes with the tokenizer file at `path`, without special tokens added."""

    def __init__(self, path: str, slots: int = 1 << 20, longest: int = 16) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.kind = np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        self.keys = np.zeros(slots, np.uint64)
        self.sizes = np.zeros(slots, np.uint8)
        self.ids = np.zeros((slots, longest), self.kind)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith(_WORD_END)]] = True

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        """The ids of every text, as uint32."""
        out: list[np.ndarray] = []
        begin = 0
        while begin < len(texts):
            end, size = begin + 1, len(texts[begin])
            while end < len(texts) and size + len(texts[end]) <= _CHUNK:
                size += len(texts[end])
                end += 1
            out += self._encode(texts[begin:end])
            begin = end
        return out

    def _words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """How many ids each word has, where they begin, and all ids.

        Words of letters, of signs, or of letters before signs are one or two pre-tokens; they are
        encoded many in a call and told apart by the ids that end a pre-token. All others, and
        calls whose ends don't add up, are encoded one by one.
        """
        parts = np.zeros(len(words), np.int64)
        for i, word in enumerate(words):
            if word.isalpha():
                parts[i] = 1
            else:
                core = word.rstrip(_SIGNS)
                parts[i] = 1 if not core else 2 * core.isalpha()
        plain = np.flatnonzero(parts)
        count, at, pool, size = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64), [np.zeros(0, np.uint32)], 0
        runs = [plain[i : i + _JOINED] for i in range(0, len(plain), _JOINED)]
        rest = [np.flatnonzero(parts == 0)]
        for run, encoded in zip(runs, self.tokenizer.encode_batch_fast([" ".join([words[i] for i in run.tolist()]) for run in runs], add_special_tokens=False), strict=True):
            flat = np.array(encoded.ids, np.uint32)
            last = np.flatnonzero(self.ends[flat]) if not len(flat) or flat.max() < len(self.ends) else []
            wanted = np.cumsum(parts[run])
            if len(last) != wanted[-1] or last[-1] != len(flat) - 1:
                rest.append(run)
                continue
            cuts = last[wanted - 1] + 1
            count[run] = np.diff(cuts, prepend=0)
            at[run] = size + cuts - count[run]
            pool.append(flat)
            size += len(flat)
        single = np.concatenate(rest)
        alone = [e.ids for e in self.tokenizer.encode_batch_fast([words[i] for i in single.tolist()], add_special_tokens=False)]
        count[single] = [len(x) for x in alone]
        at[single] = size + np.cumsum(count[single]) - count[single]
        pool += [np.array(x, np.uint32) for x in alone]
        return count, at, np.concatenate(pool)

    def _encode(self, texts: list[bytes]) -> list[np.ndarray]:
        data = b"\n".join(texts)
        hashes, starts, lengths = words_of(data)
        bounds = np.searchsorted(starts, np.concatenate(([0], np.cumsum([len(x) + 1 for x in texts]))))
        if not len(hashes):
            return [np.zeros(0, np.uint32) for _ in texts]
        keys, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        slot = (keys >> np.uint64(20)).astype(np.int64) % len(self.keys)
        known = self.keys[slot] == keys
        sizes, ids = self.sizes[slot].astype(np.int64), self.ids[slot]
        flat = [ids[known][np.arange(ids.shape[1]) < sizes[known][:, None]].astype(np.uint32)]
        new = np.flatnonzero(~known)
        at = np.zeros(len(keys), np.int64)
        at[known] = np.cumsum(sizes[known]) - sizes[known]
        if len(new):
            words = [data[s : s + n].decode() for s, n in zip(starts[first[new]].tolist(), lengths[first[new]].tolist(), strict=True)]
            count, begin, more = self._words(words)
            at[new], sizes[new] = begin + len(flat[0]), count
            flat.append(more)
            short = np.flatnonzero(count <= ids.shape[1])
            within = np.arange(ids.shape[1])[None, :]
            rows = np.where(within < count[short][:, None], more[np.minimum(begin[short][:, None] + within, max(0, len(more) - 1))] if len(more) else 0, 0)
            self.keys[slot[new[short]]], self.sizes[slot[new[short]]], self.ids[slot[new[short]]] = keys[new[short]], count[short], rows
        pool = np.concatenate(flat)
        count = sizes[inverse]
        ends = np.cumsum(count)
        tokens = pool[np.repeat(at[inverse] - (ends - count), count) + np.arange(ends[-1])]
        cut = np.concatenate(([0], ends))[bounds]
        return [tokens[a:b] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]


_HELD: dict[str, WordTokens] = {}


def word_tokens(path: str) -> WordTokens:
    """One encoder for each tokenizer and Python worker, kept between its tasks."""
    if path not in _HELD:
        _HELD[path] = WordTokens(path)
    return _HELD[path]
