"""Public tokenizers applied to the distinct words of a block, then gathered by word.

Words are stretches without ASCII white space.  None of these vocabularies joins
across white space, so a text's tokens are those of its words in order; each
distinct word of a block is encoded once.
"""

from __future__ import annotations

import functools
import os
import re

import numpy as np
import pyarrow as pa

from . import _text


def vocabulary_path(name: str) -> str:
    """The file of a public vocabulary: a path stays as it is."""
    if os.path.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


@functools.lru_cache(4)
def encoder(name: str):
    """A function from a list of words to (token ids of all after one another, number of tokens of each)."""
    path = vocabulary_path(name)
    if path.endswith(".json"):
        return word_end_encoder(path)

    if path.endswith(".tiktoken"):
        import base64

        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
        bpe = tiktoken.Encoding("public", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

        def encode(items: list[str]) -> list[list[int]]:
            return [bpe.encode_ordinary(" " + x) for x in items]

    else:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)

        def encode(items: list[str]) -> list[list[int]]:
            return sp.encode(items, num_threads=1)

    def flat(items: list[str], step: int = 20_000) -> tuple[np.ndarray, np.ndarray]:
        ids, counts = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        for a in range(0, len(items), step):
            got = encode(items[a : a + step])
            counts.append(np.fromiter(map(len, got), np.int64, len(got)))
            ids.append(np.fromiter((i for x in got for i in x), np.int32, int(counts[-1].sum())))
        return np.concatenate(ids), np.concatenate(counts)

    return flat


#: A word of Latin letters (composed) and perhaps ASCII punctuation after it, without an apostrophe
_SIMPLE = re.compile("([A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]+)([!-&(-/:-@\\[-`{-~]*)")


def word_end_encoder(path: str):
    """For a BPE vocabulary that marks the ends of words.

    Most words are one run of letters and one of punctuation, both of which the
    tokenizer's own rules take as they are: many such runs go through its model in
    one call, and the marks of word ends tell where each run stops.  All other
    words go through the whole tokenizer one by one.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer, normalizers, pre_tokenizers

    whole = Tokenizer.from_file(path)
    whole.encode_special_tokens = True
    bare = Tokenizer.from_file(path)
    bare.encode_special_tokens = True
    bare.normalizer = normalizers.Sequence([])
    bare.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
    ends = np.zeros(whole.get_vocab_size(), bool)
    for token, i in whole.get_vocab(with_added_tokens=False).items():
        ends[i] = token.endswith("</w>")
    byte_level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
    letters = {i: byte_level.pre_tokenize_str(chr(i))[0][0] for i in range(0xC0, 0x100)}

    def flat(items: list[str], step: int = 500) -> tuple[np.ndarray, np.ndarray]:
        runs, n_runs, other = [], np.zeros(len(items), np.int64), []
        for i, x in enumerate(items):
            if m := _SIMPLE.fullmatch(x):
                a, b = m.groups()
                runs.append(a.lower())
                n_runs[i] = 1
                if b:
                    runs.append(b)
                    n_runs[i] = 2
            else:
                other.append(i)
        joined = [" ".join(runs[a : a + step]).translate(letters) for a in range(0, len(runs), step)]
        ids = [np.array(e.ids, np.int32) for e in bare.encode_batch_fast(joined, add_special_tokens=False)]
        easy = np.concatenate([np.zeros(0, np.int32), *ids])
        run_ends = np.flatnonzero(ends[easy]) + 1
        if len(run_ends) != len(runs):
            raise ValueError("the vocabulary doesn't mark the end of each word")
        word_ends = np.r_[0, run_ends][np.cumsum(n_runs)]
        counts = np.diff(np.r_[0, word_ends])
        if other:
            got = [e.ids for e in whole.encode_batch_fast([items[i] for i in other], add_special_tokens=False)]
            counts[other] = [len(x) for x in got]
            heads = np.cumsum(counts) - counts
            out = np.empty(int(counts.sum()), np.int32)
            hard = np.zeros(len(items), bool)
            hard[other] = True
            out[np.repeat(~hard, counts)] = easy
            out[np.repeat(hard, counts)] = np.fromiter((i for x in got for i in x), np.int32)
            return out, counts
        return easy, counts

    return flat


@functools.lru_cache(4)
def fallback_ids(name: str) -> np.ndarray:
    """Which ids of a sentencepiece vocabulary stand for single bytes."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=vocabulary_path(name))
    return np.array([sp.is_byte(i) or sp.is_unknown(i) for i in range(sp.vocab_size())])


class Known:
    """Tokens of the words met so far, found by the words' hashes; emptied at ``most`` words."""

    def __init__(self, name: str, most: int = 800_000) -> None:
        self.encode, self.most = encoder(name), most
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.heads = np.zeros(0, np.int64)
        self.counts = np.zeros(0, np.int64)
        self.ids = np.zeros(1 << 16, np.int32)
        self.used = 0

    def find(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Where in ``ids`` each word's tokens begin, and how many there are."""
        data, at = _text.raw(words)
        h = _text.Rolling(_text.BYTE_KEY[data]).of(at[:-1], at[1:])
        if len(self.keys) + len(h) > self.most:
            self.clear()
        place = np.minimum(np.searchsorted(self.keys, h), max(0, len(self.keys) - 1))
        new = np.flatnonzero(self.keys[place] != h) if len(self.keys) else np.arange(len(h))
        if len(new):
            ids, counts = self.encode(words.take(pa.array(new)).to_pylist())
            if self.used + len(ids) > len(self.ids):
                self.ids = np.concatenate([self.ids[: self.used], np.zeros(self.used + 2 * len(ids), np.int32)])
            self.ids[self.used : self.used + len(ids)] = ids
            keys = np.concatenate([self.keys, h[new]])
            order = np.argsort(keys, kind="stable")
            self.keys = keys[order]
            self.heads = np.concatenate([self.heads, self.used + np.cumsum(counts) - counts])[order]
            self.counts = np.concatenate([self.counts, counts])[order]
            self.used += len(ids)
            place = np.searchsorted(self.keys, h)
        return self.heads[place], self.counts[place]


@functools.lru_cache(4)
def known(name: str) -> Known:
    return Known(name)


def word_tokens(coded: pa.DictionaryArray, name: str) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of all words after one another, and how many each word has."""
    index, k = coded.indices.to_numpy(), known(name)
    heads, counts = k.find(coded.dictionary)
    each = counts[index]
    return k.ids[np.repeat(heads[index], each) + _text.spread(each)], each


def word_counts(coded: pa.DictionaryArray, name: str) -> np.ndarray:
    """How many tokens each word has."""
    return known(name).find(coded.dictionary)[1][coded.indices.to_numpy()]
