"""Packing documents into fixed-length sequences: first-fit decreasing in randomised groups."""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import only, sliced, store, table, texts, trimmed
from .textkit import SHORT, Words

LENGTH = 4096
END_ID = 2
GROUP_TOKENS = 1 << 23  # tokens a group holds on average: some 2,000 sequences, a few thousand pieces
CACHE = 600_000  # words whose ids a worker keeps
SEED = 7
_PIECE = "row long, doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
_PLACED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Ids:
    """Token ids of texts, each text's with END_ID behind.

    The tokenizer never joins characters across white space, nor a letter and a full stop or comma
    behind it, so ids are worked out once for each word and remembered. Some letters end in a mark
    once normalised (U+0130, U+0958); that may be joined, and such words are worked out whole. The
    memory holds `cache` words in arrays, some 40 bytes each; when it is full it starts anew. Words
    of up to SHORT bytes are found by a hash table and told apart by all their bytes, longer ones,
    which are rare, by a dictionary.
    """

    def __init__(self, path: str, cache: int = CACHE):
        import numpy as np
        from tokenizers import Tokenizer

        self.tokenizer, self.cache = Tokenizer.from_file(path), cache
        self.bits = max(8, (2 * cache).bit_length())
        self.letters: dict[str, bool] = {}
        vocabulary = self.tokenizer.get_vocab()
        self.closes = np.zeros(max(vocabulary.values()) + 1, bool)
        self.closes[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self._forget()

    def _forget(self) -> None:
        import numpy as np

        self.slots = np.full(1 << self.bits, -1, np.int32)
        self.keys = np.zeros((3, 0), np.uint64)
        self.long: dict[bytes, int] = {}
        self.begin, self.count = np.zeros(1, np.uint32), np.ones(1, np.uint32)  # of the ids of each known word; number 0 is the end
        self.ids = np.array([END_ID], np.uint32)
        self.of = np.zeros(0, np.uint32)  # number of each key

    def _letter(self, c: str) -> bool:
        """Does c, as the tokenizer normalises it, end in a letter?"""
        if c not in self.letters:
            normalizer = self.tokenizer.normalizer
            self.letters[c] = c.isalpha() and (normalizer.normalize_str(c) if normalizer else c)[-1:].isalpha()
        return self.letters[c]

    def _encoded(self, words: list[bytes]):
        """(all ids, how many each word has). A word of a stop or comma behind a letter is worked out in two parts."""
        import numpy as np

        cut = [w[-1] in b".," and len(w) > 1 and self._letter(w[-5:].decode(errors="ignore")[-2]) for w in words]
        parts = [x for w, c in zip(words, cut, strict=True) for x in ((w[:-1], w[-1:]) if c else (w,))]
        each = [e.ids for e in self.tokenizer.encode_batch_fast([x.decode() for x in parts], add_special_tokens=False)]
        first = np.cumsum([1 + c for c in cut]) - [1 + c for c in cut]
        return np.array([i for x in each for i in x], np.uint32), np.add.reduceat([len(x) for x in each], first)

    def _plain(self, words: list[bytes]):
        """The same of words of a to z only. They go in a few long texts: each ends with the one token that closes a word."""
        import numpy as np

        if words and self.closes.any():
            whole = self.tokenizer.encode_batch_fast([b" ".join(words[at : at + 1000]).decode() for at in range(0, len(words), 1000)], add_special_tokens=False)
            ids = np.concatenate([np.array(e.ids, np.uint32) for e in whole])
            ends = np.flatnonzero(self.closes[ids]) + 1
            if len(ends) == len(words):
                return ids, np.diff(ends, prepend=0)
        return self._encoded(words) if words else (np.zeros(0, np.uint32), np.zeros(0, np.int64))

    def _learn(self, words: list[bytes]):
        """Work out the ids of distinct new words; their numbers."""
        import numpy as np

        plain = np.array([w.isalpha() and w.isascii() for w in words], bool)
        number = np.empty(len(words), np.int64)
        for which, work_out in ((np.flatnonzero(plain), self._plain), (np.flatnonzero(~plain), self._encoded)):
            if len(which):
                ids, count = work_out([words[i] for i in which.tolist()])
                number[which] = len(self.count) + np.arange(len(which))
                self.begin = np.concatenate([self.begin, (len(self.ids) + np.cumsum(count) - count).astype(np.uint32)])
                self.count = np.concatenate([self.count, count.astype(np.uint32)])
                self.ids = np.concatenate([self.ids, ids])
        return number

    def _look_up(self, keys, slot):
        """Number of each key's word, -1 where it is not known."""
        import numpy as np

        found = np.full(keys.shape[1], -1, np.int64)
        todo = np.arange(keys.shape[1])
        while len(todo):
            k = self.slots[slot[todo]]
            todo, k = todo[k >= 0], k[k >= 0]
            hit = (self.keys[:, k] == keys[:, todo]).all(axis=0)
            found[todo[hit]] = self.of[k[hit]]
            todo = todo[~hit]
            slot[todo] = (slot[todo] + 1) & (len(self.slots) - 1)
        return found

    def _enter(self, keys, slot, number) -> None:
        import numpy as np

        at = np.arange(self.keys.shape[1], self.keys.shape[1] + len(number))
        self.keys, self.of = np.concatenate([self.keys, keys], axis=1), np.concatenate([self.of, number.astype(np.uint32)])
        todo = np.arange(len(number))
        while len(todo):
            free = todo[self.slots[slot[todo]] < 0]
            self.slots[slot[free]] = at[free]
            todo = todo[self.slots[slot[todo]] != at[todo]]
            slot[todo] = (slot[todo] + 1) & (len(self.slots) - 1)

    def __call__(self, texts: list[bytes]):
        """(all ids, where each text's begin, with the end as one more)."""
        import numpy as np

        # ASCII capitals may go before the tokenizer lowers all; its special tokens are spelled as they are
        w = _parted(Words([t if b"<|" in t else t.lower() for t in texts]))
        if len(self.count) > self.cache:
            self._forget()
        word = np.zeros(len(w.starts), np.int64)
        keys = np.stack([x.astype(np.uint64) for x in w.keys()])
        slot = (w.hashes() >> np.uint64(64 - self.bits)).astype(np.int64)
        data = w.data.tobytes()
        short = np.flatnonzero(keys[2] <= SHORT)
        word[short] = self._look_up(keys[:, short], slot[short])
        new = short[word[short] < 0]
        if len(new):
            distinct, first, which = _distinct_keys(keys[:, new])
            one = new[first]
            number = self._learn([data[s:e] for s, e in zip(w.starts[one].tolist(), w.ends[one].tolist(), strict=True)])
            self._enter(distinct, slot[one], number)
            word[new] = number[which]
        long = np.flatnonzero(keys[2] > SHORT)
        if len(long):
            each = [data[s:e] for s, e in zip(w.starts[long].tolist(), w.ends[long].tolist(), strict=True)]
            unknown = [x for x in dict.fromkeys(each) if x not in self.long]
            if unknown:
                self.long.update(zip(unknown, self._learn(unknown).tolist(), strict=True))
            word[long] = [self.long[x] for x in each]
        word = np.insert(word, w.places[1:], 0)  # the end behind each text's words
        count = self.count[word].astype(np.int64)
        stop = np.cumsum(count)
        ids = self.ids[np.repeat(self.begin[word].astype(np.int64) - (stop - count), count) + np.arange(int(stop[-1]) if len(stop) else 0)]
        last = w.places[1:] + np.arange(len(texts))  # where the ends went
        return ids, np.r_[0, stop[last]]


def _parted(w: Words) -> Words:
    """Full stops and commas behind a letter a to z become words of their own."""
    import numpy as np

    if not len(w.starts):
        return w
    end, letter = w.data[w.ends - 1], w.data[w.ends - 2]  # a word of one byte has no letter in front
    cut = ((end == ord(".")) | (end == ord(","))) & (letter >= ord("a")) & (letter <= ord("z")) & (w.ends - w.starts > 1)
    to = np.arange(len(cut)) + np.cumsum(cut) - cut
    starts, ends = np.empty((2, len(cut) + int(cut.sum())), np.int64)
    starts[to], ends[to] = w.starts, w.ends - cut
    starts[to[cut] + 1], ends[to[cut] + 1] = w.ends[cut] - 1, w.ends[cut]
    w.starts, w.ends, w.places = starts, ends, w.places + np.r_[0, np.cumsum(cut)][w.places]
    return w


def _distinct_keys(keys):
    """(distinct columns, a place of each, number of every column)."""
    import numpy as np

    order = np.lexsort(keys)
    s = keys[:, order]
    new = np.r_[True, (s[:, 1:] != s[:, :-1]).any(axis=0)]
    which = np.empty(len(order), np.int64)
    which[order] = np.cumsum(new) - 1
    return s[:, new], order[new], which


def _shared_ids(path: str) -> Ids:
    """The worker process's own Ids, which outlives a task."""
    kept = sys.__dict__.setdefault("_plexmatch_ids", {})
    if path not in kept:
        kept[path] = Ids(path)
    return kept[path]


def _cut(path: str, length: int):
    def run(batches):
        import os
        import zlib

        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        of, row = _shared_ids(path), TaskContext.get().partitionId() << 33
        for batch in sliced(batches, "text"):
            ids, begin = of(texts(batch.column("text")))
            n = np.diff(begin)
            pieces = -(-n // length)
            doc = np.repeat(np.arange(batch.num_rows), pieces)
            start = (np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * length
            size = np.minimum(n[doc] - start, length)
            data, at = memoryview(ids.astype("<u4", copy=False)).cast("B"), (begin[doc] + start) * 4
            crc = [zlib.crc32(data[a:b]) for a, b in zip(at.tolist(), (at + size * 4).tolist(), strict=True)]
            docs = batch.column("doc_id").cast(pa.int64()).take(pa.array(doc))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(row, row + len(doc))), docs, pa.array(start), pa.array(size), pa.array(crc, pa.int64()), pa.array(n[doc])], names=["row", "doc_id", "start", "length", "ids_crc32", "doc_tokens"])
            row += len(doc)

    return run


def first_fit_decreasing(sizes: list[int], capacity: int) -> list[tuple[int, int]]:
    """(bin, offset) of each size; the largest first, each into the first bin with room.

    A tournament tree over the bins' free capacity finds that bin: every node holds the larger of
    its children, and the walk from the root goes left wherever the left child has room.
    """
    width = 1
    while width < max(1, len(sizes)):
        width *= 2
    tree = [capacity] * (2 * width)
    out = [(0, 0)] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        size, node = sizes[i], 1
        while node < width:
            node *= 2
            if tree[node] < size:
                node += 1
        out[i] = (node - width, capacity - tree[node])
        tree[node] -= size
        node //= 2
        while node:
            best = tree[2 * node] if tree[2 * node] >= tree[2 * node + 1] else tree[2 * node + 1]
            if tree[node] == best:
                break
            tree[node] = best
            node //= 2
    return out


def _place(length: int):
    def run(t):
        import numpy as np
        import pyarrow as pa

        t = t.sort_by("row").combine_chunks()
        placed = np.array(first_fit_decreasing(t["length"].to_pylist(), length), np.int64).reshape(-1, 2)
        group = t["part"].to_numpy().astype(np.int64)
        t = t.select(["doc_id", "start", "length", "ids_crc32", "doc_tokens"])
        return t.append_column("sequence_id", pa.array((group << 32) + placed[:, 0])).append_column("offset", pa.array(placed[:, 1]))

    return run


def packed(docs: DataFrame, tokenizer: str | None = None, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", group_tokens: int = GROUP_TOKENS, seed: int = SEED) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document's ids are those of its text and END_ID. It is cut every `length` ids; the pieces are
    dealt at random into groups of about `group_tokens` tokens, and each group is packed on its own,
    so a group has at most one sequence that nothing was left to fill. A null text counts as empty
    and gives the one id END_ID; null ids and repeated rows are packed like any row; a very long
    text is cut into many pieces, which land in different groups; an empty table gives no rows;
    other columns are not read.
    """
    d = only(docs, id_col, text_col).toDF("doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    pieces = store(d.mapInArrow(trimmed(_cut(tokenizer or default_tokenizer(), length)), _PIECE))
    total = pieces.agg(F.sum("length")).first()[0] or 0
    groups = max(1, round(total / group_tokens))
    dealt = pieces.withColumn("part", F.pmod(F.xxhash64("row", F.lit(seed)), F.lit(groups)))
    return dealt.groupBy("part").applyInArrow(_place(length), _PLACED)


def op4_packed_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))
