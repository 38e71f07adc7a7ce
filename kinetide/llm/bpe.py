"""Encoding and decoding with a public tokenizer file; chunks that documents share are encoded once.

1. Every text is cut where a rolling hash of its bytes has ten zero bits, so equal passages are cut alike. Digests of the
   chunks are counted; those found twice or more, the BOOK most frequent if there are more, are a book.
2. Each text is read once more. One without a chunk of the book is encoded where it is. Of the others, runs of other chunks
   are encoded there, and chunks of the book are handed on, once for each task.
3. Each chunk of the book is encoded once for the whole corpus, and texts are joined with it by digest.
4. Cuts may split a word. At each join the word across it is encoded again: the ids of the left part's last word and of
   the right part's first are replaced. Parts must begin and end with just those ids; where one doesn't, the stretch that
   is encoded again is the whole text.
All this holds only where ids are those of words. With other tokenizer files every text is encoded whole where it is read.
A chunk that is taken for one of the book by its filter only goes the longer way; no result depends on it.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import KeyFilter, key_filter, keyed_text, stored

#: Words that a worker process keeps in its table, and of others; ids of all of them.
CACHE_WORDS, CACHE_OTHER, CACHE_IDS = 1 << 19, 100_000, 1 << 23
#: Bytes of text that are looked up together, up to which words are looked up one by one, and of the table's longest word.
PIECE, FEW_BYTES, LONGEST = 1 << 20, 1 << 13, 24
#: Fixed values of the cutter: mean chunk 2**CUT_BITS bytes, none below LEAST but a text's last, none above MOST.
CUT_BITS, LEAST, MOST = 10, 64, 1 << 16
#: Most chunks of the book, as its filter is broadcast (16 bits each), and chunks that a task remembers to have handed on.
BOOK, SEEN = KeyFilter.MOST // KeyFilter.EACH, 1 << 20
GEAR = np.random.RandomState(7).randint(0, 2**32, 256, dtype=np.uint64).astype(np.uint32)
#: Marks that may end a word; the apostrophe is not one, as patterns join it with letters.
MARKS = b".,;:!?#*$%&|)"


#: Kinds of bytes: space, lower-case letter, mark, other; and which characters below U+0280 are lower-case letters.
KIND = np.full(256, 3, np.uint8)
KIND[list(b" \t\n\r\x0b\x0c")], KIND[97:123], KIND[list(MARKS)] = 0, 1, 2
LOWER = np.array([0x80 <= k < 0x250 and chr(k).isalpha() and chr(k).lower() == chr(k) for k in range(0x280)])
#: The first bytes of eight, as a little-endian number.
FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: ASCII white space, as bytes.split() takes it.
SPACE = b" \t\n\r\x0b\x0c"
GAP = re.compile(rb"[ \t\n\r\x0b\x0c]")


def _by_word(file: dict) -> bool:
    """Whether a tokenizer's own pre-tokenizer drops white space, so that a text's ids are its words' ids in order."""
    pre = file.get("pre_tokenizer") or {}
    first = (pre.get("pretokenizers") or [pre])[0]
    regex = first.get("pattern", {}).get("Regex", "") if first.get("type") == "Split" else ""
    return first.get("behavior") == "Removed" and bool(first.get("invert")) and regex.endswith(r"[^\s\p{L}\p{N}]+") and r"\s+" not in regex


def _parted(text: bytes):
    """``text`` in parts of about PIECE bytes, cut at white space."""
    a = 0
    while a < len(text):
        cut = GAP.search(text, a + PIECE)
        b = cut.start() if cut else len(text)
        yield text[a:b]
        a = b


def tokenizer_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordTable:
    """Words of up to LONGEST bytes, none of them zero, as three numbers each, and their places in a list; open addressing
    in arrays, so that many words are looked up by a few operations. Words are compared whole, never by hash."""

    def __init__(self, words: int):
        self.bits = (2 * words - 1).bit_length()
        self.at = np.full(1 << self.bits, -1, np.int32)
        self.words = [np.zeros(1 << self.bits, np.uint64) for _ in range(3)]

    def slots(self, key: list[np.ndarray]) -> np.ndarray:
        with np.errstate(over="ignore"):
            h = key[0] * np.uint64(0x9E3779B97F4A7C15)
            for x, by in ((key[1], 0xBF58476D1CE4E5B9), (key[2], 0x94D049BB133111EB)):
                h = ((h ^ (h >> np.uint64(29))) + x) * np.uint64(by)
        return (h >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, key: list[np.ndarray]) -> np.ndarray:
        """The place of each word, or -1."""
        slot = self.slots(key)
        out = self.at[slot]
        left = np.flatnonzero((out >= 0) & np.logical_or.reduce([w[slot] != x for w, x in zip(self.words, key, strict=True)]))
        while len(left):
            slot[left] = slot[left] + 1 & len(self.at) - 1
            now = slot[left]
            out[left] = self.at[now]
            left = left[(out[left] >= 0) & np.logical_or.reduce([w[now] != x[left] for w, x in zip(self.words, key, strict=True)])]
        return out

    def add(self, key: list[np.ndarray], places: np.ndarray) -> None:
        """Words that the table does not have, and their places."""
        slot, left = self.slots(key), np.arange(len(places))
        while len(left):
            now = slot[left]
            free = self.at[now] < 0
            self.at[now[free]] = places[left[free]]
            mine = self.at[now] == places[left]  # of several that took a slot, the last has it
            for w, x in zip(self.words, key, strict=True):
                w[now[mine]] = x[left[mine]]
            left = left[~mine]
            slot[left] = slot[left] + 1 & len(self.at) - 1


class Encoder:
    """A tokenizer file as a map from bytes to ids, which are little-endian and two bytes wide if the vocabulary allows.

    Where the file's own pre-tokenizer drops white space, a text's ids are its words' ids in order, so words are looked
    up and only new ones are encoded. Words of plain lower-case letters, and the marks at their ends, are found by their
    bytes' kinds and looked up together in a table; all others one by one. Other files encode whole texts.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_padding()
        self.tok.no_truncation()
        self.dtype = np.dtype("<u2") if self.tok.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        self.by_word = _by_word(file)
        self.words = None
        self.few: dict[bytes, bytes] = {}
        if self.by_word:
            self._forget()
        if self.by_word and self.tok.model.end_of_word_suffix:
            from tokenizers import Tokenizer, pre_tokenizers
            from tokenizers.models import BPE

            # For words of plain lower-case letters, normalising and splitting by pattern change nothing, and words that
            # the caches here don't have are too rare for the library's.
            model = BPE(file["model"]["vocab"], [tuple(m.split(" ") if isinstance(m, str) else m) for m in file["model"]["merges"]], cache_capacity=0, end_of_word_suffix=self.tok.model.end_of_word_suffix)
            self.words, self.ascii = Tokenizer(model), Tokenizer(model)
            self.ascii.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
            self.words.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
            self.ends = np.zeros(self.tok.get_vocab_size(), bool)
            for token, k in self.tok.get_vocab().items():
                self.ends[k] = token.endswith(self.tok.model.end_of_word_suffix)

    def _forget(self) -> None:
        self.table, self.others = WordTable(CACHE_WORDS), {}
        # Where each known word's ids begin, how many there are, and the ids.
        self.start, self.n, self.pool = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64), np.zeros(1 << 18, self.dtype)
        self.known, self.used = 0, 0

    def _plain(self, texts: list[bytes]) -> list[bytes]:
        return [np.array(e.ids, self.dtype).tobytes() for e in self.tok.encode_batch_fast([t.decode("utf-8") for t in texts], add_special_tokens=False)]

    def _letters(self, words: list[bytes], tok) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words of plain letters, end to end, and how many each has; many words in one call, each ends where a token
        has the end-of-word mark."""
        out, counts = [], []
        for k in range(0, len(words), 300):
            some = words[k : k + 300]
            ids = np.array(tok.encode_batch_fast([b" ".join(some).decode("utf-8")], add_special_tokens=False)[0].ids, self.dtype)
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) != len(some) or ends[-1] != len(ids):
                ids, own = self._whole(some)
            else:
                own = np.diff(ends, prepend=0)
            out.append(ids)
            counts.append(own)
        return np.concatenate(out), np.concatenate(counts)

    def _whole(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        found = self._plain(words)
        return np.frombuffer(b"".join(found), self.dtype), np.array([len(x) // self.dtype.itemsize for x in found], np.int64)

    def _keep(self, ids: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The places of new words whose ids, end to end, are ``ids``."""
        a, u = self.known, self.used
        self.known, self.used = a + len(n), u + len(ids)
        for name, need in (("start", self.known), ("n", self.known), ("pool", self.used)):
            old = getattr(self, name)
            if need > len(old):
                new = np.zeros(max(need, 2 * len(old)), old.dtype)
                new[: len(old)] = old
                setattr(self, name, new)
        self.start[a : self.known], self.n[a : self.known], self.pool[u : self.used] = u + np.cumsum(n) - n, n, ids
        return np.arange(a, self.known)

    def _units(self, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and whether it is looked up in the table, of every unit: plain letters, marks at their end, or a
        whole other word. ``b`` begins and ends with a space."""
        kind = KIND[b]
        lead = np.flatnonzero((b >= 0xC2) & (b < 0xCA))
        if self.words is None:
            kind[kind != 0] = 3
        elif len(lead):
            lead = lead[LOWER[(b[lead] & 0x1F).astype(np.int64) << 6 | b[lead + 1] & 0x3F]]
            kind[lead] = kind[lead + 1] = 1
        run = np.concatenate([[0], np.flatnonzero(kind[1:] != kind[:-1]) + 1])
        of, size = kind[run], np.diff(run, append=len(b))
        gap = np.flatnonzero(of == 0)
        word = gap[:-1] + 1  # the first run of each word
        marked = of[word + 1] == 2
        plain = (of[word] == 1) & (size[word] <= LONGEST) & (word + 1 + marked == gap[1:]) & (~marked | (size[word + 1] <= LONGEST))
        marked &= plain
        start, end = run[word], run[np.where(plain, word + 1, gap[1:])]
        at = np.flatnonzero(marked) + 1
        more = word[marked] + 1
        return np.insert(start, at, run[more]), np.insert(end, at, run[more + 1]), np.insert(plain, at, True)

    def _places(self, data: bytes, b: np.ndarray, start: np.ndarray, end: np.ndarray, quick: np.ndarray) -> np.ndarray:
        """The place of each unit; new ones are encoded."""
        out = np.empty(len(start), np.int64)
        s, n = start[quick], (end - start)[quick]
        eight = np.lib.stride_tricks.as_strided(b.view(np.uint8), (len(b) - 7, 8), (1, 1)).view("<u8")[:, 0]
        key = [eight[s + k] & FIRST[np.clip(n - k, 0, 8)] for k in (0, 8, 16)]
        at = self.table.find(key).astype(np.int64)
        new = np.flatnonzero(at < 0)
        if len(new):
            mine = [x[new] for x in key]
            order = np.lexsort(mine)
            differs = np.logical_or.reduce([x[order][1:] != x[order][:-1] for x in mine])
            group = np.concatenate([[0], np.cumsum(differs)])
            one = order[np.concatenate([[0], np.flatnonzero(differs) + 1])]
            words = [data[i:j] for i, j in zip(s[new[one]].tolist(), (s + n)[new[one]].tolist(), strict=True)]
            # Marks, words of a to z alone, and words with other letters each have their way.
            way = np.array([0 if w[0] in MARKS else 1 if w.isascii() else 2 for w in words])
            place = np.empty(len(words), np.int64)
            for k, made in enumerate((self._whole, lambda x: self._letters(x, self.ascii), lambda x: self._letters(x, self.words))):
                some = np.flatnonzero(way == k)
                if len(some):
                    place[some] = self._keep(*made([words[i] for i in some.tolist()]))
            self.table.add([x[one] for x in mine], place)
            at[new[order]] = place[group]
        out[quick] = at
        if not quick.all():
            slow = np.flatnonzero(~quick)
            words = [data[i:j] for i, j in zip(start[slow].tolist(), end[slow].tolist(), strict=True)]
            fresh = list(set(words).difference(self.others))
            if fresh:
                self.others.update(zip(fresh, self._keep(*self._whole(fresh)).tolist(), strict=True))
            out[slow] = [self.others[w] for w in words]
        return out

    def _looked_up(self, texts: list[bytes]) -> list[bytes]:
        if self.known > CACHE_WORDS // 2 or len(self.others) > CACHE_OTHER or self.used > CACHE_IDS:
            self._forget()
        first = np.cumsum([1, *[len(t) + 1 for t in texts]])
        data = b"".join([b" ", *[t + b" " for t in texts], bytes(LONGEST + 8)])
        b = np.frombuffer(data, np.uint8)
        start, end, quick = self._units(b[: first[-1]])
        at = self._places(data, b, start, end, quick)
        n = self.n[at]
        ends = np.concatenate([[0], np.cumsum(n)])
        raw = self.pool[np.arange(ends[-1]) + np.repeat(self.start[at] - ends[:-1], n)].tobytes()
        cuts = (ends[np.searchsorted(start, first)] * self.dtype.itemsize).tolist()
        return [raw[i:j] for i, j in zip(cuts, cuts[1:], strict=False)]

    def _one_by_one(self, texts: list[bytes]) -> list[bytes]:
        if len(self.few) > CACHE_OTHER:
            self.few.clear()
        words = [t.split() for t in texts]
        new = list(set().union(*words).difference(self.few))
        if new:
            self.few.update(zip(new, self._plain(new), strict=True))
        return [b"".join([self.few[w] for w in ws]) for ws in words]

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text, as bytes."""
        if not self.by_word:
            return self._plain(texts)
        # Letters before combining marks stay as they are: composing comes before lower case.
        low = [t if b"\xcc" in t or b"\xcd" in t or b"<|" in t else t.lower() for t in texts]
        if sum(map(len, low)) <= FEW_BYTES:
            return self._one_by_one(low)
        out, some, size = [], [], 0
        for t in low:
            if some and size + len(t) > PIECE:
                out += self._looked_up(some)
                some, size = [], 0
            if len(t) > PIECE:
                out.append(b"".join(x for part in _parted(t) for x in self._looked_up([part])))
                continue
            some.append(t)
            size += len(t)
        return out + self._looked_up(some) if some else out

    def decode(self, ids: list[bytes]) -> list[str]:
        return self.tok.decode_batch([np.frombuffer(x, self.dtype).tolist() for x in ids], skip_special_tokens=False)


@functools.lru_cache(2)
def encoder(path: str) -> Encoder:
    """One for each worker process."""
    return Encoder(path)


def cut(data: bytes) -> list[int]:
    """Where the chunks of ``data`` end; always at the start of a character."""
    n = len(data)
    h = GEAR[np.frombuffer(data, np.uint8)]
    for k in (1, 2, 4, 8, 16):
        if k < n:
            step = h.copy()
            step[k:] += h[:-k] << np.uint32(k)
            h = step
    ends, last = [], 0
    for p in [*(np.flatnonzero(h >> np.uint32(32 - CUT_BITS) == 0) + 1).tolist(), n]:
        while p - last > MOST + LEAST:
            q = last + MOST
            while q < n and data[q] & 0xC0 == 0x80:
                q += 1
            ends.append(q)
            last = q
        while p < n and data[p] & 0xC0 == 0x80:
            p += 1
        if p < n and p - last >= LEAST:
            ends.append(p)
            last = p
    return [*ends, n] if n else []


def chunks(data: bytes) -> list[tuple[bytes, bytes]]:
    """(digest, bytes) of each chunk."""
    out, a = [], 0
    for b in cut(data):
        part = data[a:b]
        out.append((hashlib.blake2b(part, digest_size=16).digest(), part))
        a = b
    return out


def _texts(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    return batch.column(batch.schema.get_field_index(name)).cast(pa.large_binary()).to_pylist()


def _keys(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(d[:8] for d in digests), "<i8")


def shared_chunks(rows: DataFrame) -> KeyFilter:
    """A filter of the digests of chunks that occur twice or more; of more than BOOK, the most frequent that fit."""

    def digests(batches):
        for batch in batches:
            seen: dict[bytes, int] = {}
            for t in _texts(batch):
                for d, _ in chunks(t):
                    seen[d] = seen.get(d, 0) + 1
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(_keys(list(seen))), pa.array(list(seen.values()), pa.int64())], ["digest", "key", "n"])

    counted = rows.select("text").mapInArrow(digests, "digest binary, key long, n long").groupBy("digest").agg(F.first("key").alias("key"), F.sum("n").alias("n")).where("n > 1")
    counted = stored(counted, "bpe-counts")
    least = 2
    by_count = counted.groupBy(F.floor(F.log2("n")).cast("int").alias("power")).agg(F.count(F.lit(1)).alias("k"))
    total = 0
    for r in sorted(by_count.collect(), key=lambda r: -r["power"]):  # 64 rows at most
        total += r["k"]
        if total > BOOK:
            least = 1 << r["power"] + 1
            break
    return key_filter(counted.where(F.col("n") >= least), "key")


def _ends(part: bytes) -> tuple[bytes, bytes | None]:
    """What comes before the first white space, and what comes after the last; (all, None) without any."""
    at = [k for k in (part.find(s) for s in (SPACE[i : i + 1] for i in range(6))) if k >= 0]
    if not at:
        return part, None
    return part[: min(at)], part[max(part.rfind(SPACE[i : i + 1]) for i in range(6)) + 1 :]


def agreeing(enc: Encoder, parts: list[bytes], ids: list[bytes]) -> list[bool]:
    """Whether each part's ids begin and end with those of its first and last word, so that these can be replaced."""
    both = [_ends(p) for p in parts]
    ends = iter(enc.encode([x for head, tail in both if tail is not None for x in (head, tail)]))
    out = []
    for (_, tail), x in zip(both, ids, strict=True):
        if tail is None:
            out.append(True)
            continue
        a, b = next(ends), next(ends)
        out.append(x.startswith(a) and x.endswith(b) and len(x) >= len(a) + len(b))
    return out


def join_parts(enc: Encoder, parts: list[tuple[bytes, bytes | None, bytes]]) -> bytes:
    """The ids of a text from its parts (head, tail, ids), which agree with their ends (see agreeing)."""
    ends = enc.encode([x for head, tail, _ in parts if tail is not None for x in (head, tail)])
    out, across, todo = [], b"", []
    k = 0
    for head, tail, ids in parts:
        if tail is None:
            across += head
            continue
        a, b = ends[k], ends[k + 1]
        k += 2
        todo.append(across + head)
        out += [b"", ids[len(a) : len(ids) - len(b)]]
        across = tail
    out[::2] = enc.encode(todo)
    return b"".join([*out, *enc.encode([across])])


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", result=None, schema: str = "ids binary") -> DataFrame:
    """Each row's ``key`` and its ``ids`` (little-endian, see Encoder), or what ``result(encoder, list of ids)`` makes of
    them: a list of columns as ``schema`` names them.

    Null and empty texts have no ids; repeated rows and ids stay as they are, one result for each; an empty table gives an
    empty one; other columns are not read. ``path`` must lead to the tokenizer file on the driver and every executor.
    """
    spark = docs.sparkSession
    rows = keyed_text(docs, id_col, text_col)
    made = result or (lambda enc, ids: [pa.array(ids, pa.binary())])
    names = [x.split()[0] for x in schema.split(",")]

    def whole(batches):
        enc = encoder(path)
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                part = batch.slice(k, 500)
                yield pa.RecordBatch.from_arrays([part.column(0), *made(enc, enc.encode(_texts(part)))], ["key", *names])

    with open(path, encoding="utf-8") as f:
        by_word = _by_word(json.load(f))
    if not by_word:
        return rows.mapInArrow(whole, f"key long, {schema}")
    book = spark.sparkContext.broadcast(shared_chunks(rows))
    piece = pa.list_(pa.struct([("pos", pa.int32()), ("digest", pa.binary()), ("head", pa.binary()), ("tail", pa.binary()), ("own", pa.binary())]))
    chunk = pa.list_(pa.struct([("digest", pa.binary()), ("part", pa.binary())]))

    def read(batches):
        enc, seen = encoder(path), set()
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                some = batch.slice(k, 500)
                texts = _texts(some)
                cuts = [chunks(t) for t in texts]
                flags = iter(book.value.has(_keys([d for found in cuts for d, _ in found])).tolist())
                plain, joined, fresh, alone = [], {}, [[] for _ in texts], []
                for i, found in enumerate(cuts):
                    mine = [next(flags) for _ in found]
                    if not any(mine):
                        plain.append(i)
                        continue
                    lines: list[list] = []  # (digest or None, bytes); what lies between chunks of the book is one
                    for (d, part), is_shared in zip(found, mine, strict=True):
                        if is_shared:
                            lines.append([d, part])
                            if d not in seen:
                                seen.add(d)
                                fresh[i].append({"digest": d, "part": part})
                        elif lines and lines[-1][0] is None:
                            lines[-1][1] += part
                        else:
                            lines.append([None, part])
                    joined[i] = lines
                    alone += [part for d, part in lines if d is None]
                if len(seen) > SEEN:
                    seen = set()
                ids = enc.encode(alone)
                own = iter(zip(ids, agreeing(enc, alone, ids), strict=True))
                pieces: list[list | None] = [None] * len(texts)
                for i, lines in joined.items():
                    made_here = [None if d is not None else next(own) for d, _ in lines]
                    if any(x is not None and not x[1] for x in made_here):
                        plain.append(i)
                    else:
                        pieces[i] = [dict(zip(("pos", "digest", "head", "tail", "own"), (pos, d, *_ends(part), x and x[0]), strict=True)) for pos, ((d, part), x) in enumerate(zip(lines, made_here, strict=True))]
                place = np.full(len(texts), -1)
                place[plain] = np.arange(len(plain))
                done = [c.take(pa.array(place, mask=place < 0)) for c in made(enc, enc.encode([texts[i] for i in plain]))]
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(2), *done, pa.array(pieces, piece), pa.array(fresh, chunk)], ["key", "hash", *names, "pieces", "fresh"])

    def encoded(batches):
        enc = encoder(path)
        for batch in batches:
            parts = _texts(batch, "part")
            ids = enc.encode(parts)
            ids = [x if ok else None for x, ok in zip(ids, agreeing(enc, parts, ids), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], ["digest", "ids"])

    def joined(batches):
        enc = encoder(path)
        for batch in batches:
            ids = [join_parts(enc, [(x["head"], x["tail"], x["ids"]) for x in found]) for found in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *made(enc, ids)], ["key", *names])

    first = rows.withColumn("hash", F.xxhash64("text")).mapInArrow(read, f"key long, hash long, {schema}, pieces array<struct<pos:int,digest:binary,head:binary,tail:binary,own:binary>>, fresh array<struct<digest:binary,part:binary>>")
    first = stored(first.withColumn("row", F.monotonically_increasing_id()), "bpe-read")
    parts = first.select(F.explode("fresh").alias("x")).select("x.*").groupBy("digest").agg(F.first("part").alias("part"))
    ids = stored(parts.mapInArrow(encoded, "digest binary, ids binary"), "bpe-book").withColumnRenamed("digest", "d")
    lines = first.where("pieces is not null").select("row", "key", "hash", F.explode("pieces").alias("x"))
    there = lines.where("x.digest is not null").join(ids, F.col("x.digest") == F.col("d"), "left").select("row", "key", "hash", F.struct("x.pos", "x.head", "x.tail", "ids").alias("x"))
    here = lines.where("x.digest is null").select("row", "key", "hash", F.struct("x.pos", "x.head", "x.tail", F.col("x.own").alias("ids")).alias("x"))
    found = there.unionByName(here).groupBy("row", "key", "hash").agg(F.array_sort(F.collect_list("x")).alias("parts"))
    out = first.where("pieces is null").select("key", *names)
    if ids.where("ids is null").isEmpty():
        return out.unionByName(found.select("key", "parts").mapInArrow(joined, f"key long, {schema}"))
    broken = F.exists("parts", lambda x: x["ids"].isNull())
    found = stored(found, "bpe-parts")
    again = found.where(broken).select(F.col("key").alias("k"), F.col("hash").alias("h")).distinct()
    texts = rows.join(again, F.col("key").eqNullSafe(F.col("k")) & (F.xxhash64("text") == F.col("h")), "left_semi")
    return out.unionByName(found.where(~broken).select("key", "parts").mapInArrow(joined, f"key long, {schema}")).unionByName(texts.mapInArrow(whole, f"key long, {schema}"))


def digests(enc: Encoder, ids: list[bytes]) -> list[pa.Array]:
    """n_tokens, sha256 of the decimal ids joined by a space, sha256 of the text they decode to."""
    texts = enc.decode(ids)
    lists = [np.frombuffer(x, enc.dtype).tolist() for x in ids]
    said = [hashlib.sha256(" ".join(map(str, x)).encode()).hexdigest() for x in lists]
    return [pa.array([len(x) for x in lists], pa.int64()), pa.array(said, pa.string()), pa.array([hashlib.sha256(t.encode("utf-8")).hexdigest() for t in texts], pa.string())]


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return encode(docs, tokenizer_file(), result=digests, schema="n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("key", "doc_id")
