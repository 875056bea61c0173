"""Exact token counts of all prefixes of a text by dynamic programming."""

from __future__ import annotations

import json
import re
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import release, tokenizer_path
from quillon.llm.tokens import loaded

#: Words, and pieces of words, whose tables a worker keeps, at most, and how long these may be; others are made
#: again when they come again. So are the answers about pairs of tokens.
KEPT, KEPT_PIECES, LONGEST_KEPT, PAIRS = 150_000, 800_000, 64, 2_000_000
#: The rank of no merge.
NEVER = 1 << 30
ASCII_SPACE = re.compile("[ \t\n\r\f\v]+")
#: Python takes these four as white space, the vocabulary's patterns don't.
SEPARATORS = "\x1c\x1d\x1e\x1f"
#: Words in which normalising, special strings or contractions may join characters, or in which
#: Python's character classes differ from the vocabulary's.
UNPLAIN = re.compile("[^\x00-\u024f]|<\\||'|[\u0130\xb2\xb3\xb9\xbc-\xbe\x1c-\x1f]")
#: Tables are read so many characters at a time, texts so many rows.
READ, ROWS = 1 << 22, 1024


class PrefixCounts:
    """Counts by a word-level BPE vocabulary with ends of words, as ``tokenizers`` gives them.

    No token reaches over white space, so the table of a text is count[end of word] = count[end
    of the word before] + tokens of the word, and inside a word the table of the word's prefixes.
    A table is stored by its steps: a signed byte for each character says by how much the count of
    the prefix that ends with it differs from that of the prefix before it.
    """

    def __init__(self, tokenizer: str):
        from tokenizers import Tokenizer

        self.path = tokenizer_path(tokenizer)
        self.library = Tokenizer.from_file(self.path)
        self.kept: dict[str, bytes] = {}
        self.bpe: WordPrefixes | None = None
        self.rules: Rules | None = None

    def words(self, text: str) -> list[str]:
        if any(c in text for c in SEPARATORS):
            return [w for w in ASCII_SPACE.split(text) if w]
        return text.split()

    def steps(self, text: str) -> bytes:
        """The table of a text, as steps."""
        words = self.words(text)
        get, make = self.kept.get, self.steps_in_word
        made = [get(w) or make(w) for w in words]
        if len(words) + sum(map(len, words)) - 1 == len(text):
            return b"\0".join(made)  # one character of white space between two words
        out, at = [], 0
        for w, d in zip(words, made, strict=True):
            start = text.index(w, at)
            out += (bytes(start - at), d)
            at = start + len(w)
        return b"".join([*out, bytes(len(text) - at)])

    def steps_in_word(self, word: str) -> bytes:
        if self.bpe is None:
            self.bpe = WordPrefixes(self.path)
        if UNPLAIN.search(word):
            out = np.diff(self.in_any_word(word))
            if len(out) and max(out.max(), -out.min()) > 127:  # no token and no special string is so long
                raise ValueError("a step doesn't fit a byte")
            out = out.astype(np.int8).tobytes()
        else:
            out = b"".join(map(self.bpe.steps, self.bpe.pieces.findall(word)))
        if len(word) <= LONGEST_KEPT and len(self.kept) < KEPT:
            self.kept[word] = out
        return out

    def in_word(self, word: str) -> np.ndarray:
        """Exact counts of all prefixes of a word, the empty one first."""
        if self.bpe is None:
            self.bpe = WordPrefixes(self.path)
        if UNPLAIN.search(word):
            return self.in_any_word(word)
        return counts(b"".join(map(self.bpe.steps, self.bpe.pieces.findall(word))))

    def in_any_word(self, word: str) -> np.ndarray:
        """As ``in_word``, of words whose characters may join or be special strings."""
        if self.rules is None:
            self.rules = Rules(self.library)
        out, at, done = np.zeros(len(word) + 1, np.int64), 0, 0
        for start, end in [*(m.span() for m in self.rules.special.finditer(word)), (len(word), len(word) + 1)]:
            # A special string counts as one token once it is whole, as plain signs and letters before.
            run = Prefixes(self.bpe, self.rules)
            inside = run.counts(word[at : end - 1])
            out[at:end] = done + inside
            if end <= len(word):
                done += int(inside[start - at]) + 1
                out[end] = done
            at = end
        return out


def total(steps: bytes) -> int:
    """Tokens of the whole text, from its table."""
    return int(np.frombuffer(steps, np.int8).sum(dtype=np.int64))


def longest(steps: bytes, limit: int) -> int:
    """Length in characters of the longest prefix that has at most ``limit`` tokens, from its table."""
    all_steps, done, best = np.frombuffer(steps, np.int8), 0, 0
    for at in range(0, len(all_steps), READ):
        counts = np.cumsum(all_steps[at : at + READ], dtype=np.int64) + done
        done = int(counts[-1])
        fits = np.flatnonzero(counts <= limit)
        best = at + int(fits[-1]) + 1 if len(fits) else best
    return best


def counts(steps: bytes) -> np.ndarray:
    """The exact count of every prefix: item i is that of the first i characters."""
    return np.concatenate([[0], np.cumsum(np.frombuffer(steps, np.int8), dtype=np.int64)])


class WordPrefixes:
    """Counts of all prefixes of a run of letters, digits or signs, from the vocabulary's merges.

    A sequence of tokens is what merging gives if and only if this holds for each two neighbours.
    So the last token of a prefix is the one token that ends there and stands well beside the
    last token of what is before it; the table goes on from left to right. A prefix's own last
    token carries the end of the word.
    """

    pieces = re.compile(r"[^\W\d_]+|\d|(?:[^\w\s]|_)+")

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        self.end = model["end_of_word_suffix"] or ""
        self.vocab = model["vocab"]
        pairs = (tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"])
        self.rank = {p: i for i, p in enumerate(pairs)}
        self.longest = max(map(len, self.vocab))
        #: Length of the longest token with a last character, within a run and at its end.
        self.reach: dict[str, int] = {}
        self.reach_end: dict[str, int] = {}
        for t in self.vocab:
            closes = bool(self.end) and t.endswith(self.end) and t != self.end
            of, t = (self.reach_end, t.removesuffix(self.end)) if closes else (self.reach, t)
            of[t[-1]] = max(of.get(t[-1], 0), len(t))
        # The byte-level alphabet: printable Latin-1 stands for itself, the rest from 256 on.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in plain]
        self.byte = dict(zip(plain, map(chr, plain), strict=True)) | {b: chr(256 + i) for i, b in enumerate(rest)}
        # Tokens within a run and, without its mark, at the end of one; those that merging can't end with are taken out once that is known.
        self.inner = set(self.vocab)
        self.outer = {t.removesuffix(self.end) for t in self.vocab if t.endswith(self.end)}
        # The edges of tokens that come out of merging their characters, None for others, and whether a pair comes
        # out of merging both, inside a run and at its end.
        self.alone: dict[str, tuple[list, list] | None] = {}
        self.alone_end: dict[str, tuple[list, list] | None] = {}
        self.beside: dict[tuple[str, str], bool] = {}
        self.beside_end: dict[tuple[str, str], bool] = {}
        self.kept: dict[str, bytes] = {}

    def merged(self, symbols: list[str]) -> list[str]:
        while len(symbols) > 1:
            rank, at = min((self.rank.get(p, NEVER), i) for i, p in enumerate(zip(symbols, symbols[1:], strict=False)))
            if rank == NEVER:
                break
            symbols = [*symbols[:at], symbols[at] + symbols[at + 1], *symbols[at + 2 :]]
        return symbols

    def edges(self, token: str, closes: bool) -> tuple[list, list] | None:
        """What stands at a token's left and right edge while its characters merge, each with the rank of the merge that takes it.

        None if merging doesn't end with the token.
        """
        known = self.alone_end if closes else self.alone
        if token not in known:
            symbols = list(token)
            if closes:
                symbols[-1] += self.end
            left, right = [], []
            while len(symbols) > 1:
                rank, at = min((self.rank.get(p, NEVER), i) for i, p in enumerate(zip(symbols, symbols[1:], strict=False)))
                if rank == NEVER:
                    break
                if at == 0:
                    left.append((symbols[0], rank))
                if at == len(symbols) - 2:
                    right.append((symbols[-1], rank))
                symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
            known[token] = None if len(symbols) > 1 else ([*left, (symbols[0], NEVER)], [*right, (symbols[0], NEVER)])
            if len(symbols) > 1:
                (self.outer if closes else self.inner).discard(token)
        return known[token]

    def stands(self, left: str, right: str, closes: bool) -> bool:
        """Whether merging left + right gives these two tokens (just ``right`` if left is empty).

        A merge has a higher rank than those that made its parts, so merges go by rank. The two
        stay apart unless what meets at their edges at some time merges before either side goes on;
        of one rank, what is further left is first.
        """
        own = self.edges(right, closes)
        if own is None or not left:
            return own is not None
        known, key = self.beside_end if closes else self.beside, (left, right)
        got = known.get(key)
        if got is None:
            before, after, i, j = self.edges(left, False)[1], own[0], 0, 0
            while got is None:
                (x, a), (y, b) = before[i], after[j]
                r = self.rank.get((x, y), NEVER)
                if r < a and r <= b and r < NEVER:
                    got = False
                elif a == b == NEVER:
                    got = True
                elif a <= b:
                    i += 1
                else:
                    j += 1
            if len(known) >= PAIRS:
                known.clear()
            known[key] = got
        return got

    def steps(self, piece: str) -> bytes:
        """By how much the counts of a piece's prefixes grow, a signed byte for each character."""
        low = piece.lower()
        out = self.kept.get(low)
        if out is None:
            counts = self.counts(low)
            out = bytes(b - a & 255 for a, b in zip(counts, counts[1:], strict=False))  # tokens are shorter than 127
            if len(low) <= LONGEST_KEPT and len(self.kept) < KEPT_PIECES:
                self.kept[low] = out
        return out

    def counts(self, piece: str) -> list[int]:
        """Counts of all prefixes of a piece in lower case, the empty one first."""
        s = piece.encode().decode("latin-1").translate(self.byte)
        tokens, alone, beside, reach = self.inner, self.alone, self.beside, self.reach
        last, count = [""], [0]
        for i in range(1, len(s) + 1):
            for n in range(1, min(i, reach.get(s[i - 1], 1)) + 1):
                t = s[i - n : i]
                if t in tokens:
                    left = last[i - n]
                    fits = beside.get((left, t)) if left else t in alone or self.stands("", t, False)
                    if fits or fits is None and self.stands(left, t, False):
                        last.append(t)
                        count.append(count[i - n] + 1)
                        break
            else:
                raise ValueError(f"no token ends {piece[:20]!r}")
        out, at = [0], 0
        tokens, alone, beside, reach = self.outer, self.alone_end, self.beside_end, self.reach_end
        for size in map(len, piece) if len(s) == len(piece) else (len(c.encode()) for c in piece):
            at += size
            for n in range(1, min(at, reach.get(s[at - 1], 1)) + 1):
                t = s[at - n : at]
                if t in tokens:
                    left = last[at - n]
                    fits = beside.get((left, t)) if left else t in alone or self.stands("", t, True)
                    if fits or fits is None and self.stands(left, t, True):
                        out.append(count[at - n] + 1)
                        break
            else:
                raise ValueError(f"no token ends {piece[:20]!r}")
        return out


class Rules:
    """What the vocabulary's normalising and splitting do with characters, asked of the library once for each."""

    def __init__(self, library):
        from tokenizers.normalizers import NFC

        self.compose = NFC().normalize_str
        self.normal, self.split = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str
        special = [re.escape(t.content) for t in library.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(special) or "(?!)")
        # Second characters of canonical pairs, vowels and finals of Hangul.
        pairs = (unicodedata.decomposition(chr(c)).split() for c in range(sys.maxunicode + 1))
        self.seconds = {chr(int(d[1], 16)) for d in pairs if len(d) == 2 and d[0][0] != "<"}
        self.seconds |= {*map(chr, range(0x1161, 0x1176)), *map(chr, range(0x11A8, 0x11C3))}
        self.known: dict[str, list[tuple[str, str, bytes]]] = {}
        self.first: dict[str, bool] = {}

    def begins(self, c: str) -> bool:
        """Whether a character never joins, nor changes places with, what is before it."""
        if c not in self.first:
            d = unicodedata.normalize("NFD", c)[0]
            self.first[c] = not unicodedata.combining(d) and d not in self.seconds
        return self.first[c]

    def lowered(self, c: str) -> list[tuple[str, str, bytes]]:
        """The characters that one composed character becomes, each with its kind and bytes.

        Kinds: letter L, number N, white space W, all others S.
        """
        if c not in self.known:
            found = []
            for x in self.normal(c):
                if not self.split(x):
                    kind = "W"
                else:
                    kind = "L" if len(self.split("a" + x)) == 1 else "S" if len(self.split("!" + x)) == 1 else "N"
                found.append((x, kind, x.encode()))
            self.known[c] = found
        return self.known[c]


class Prefixes:
    """The counts of a growing text; its last composed characters can be taken back.

    ``texts`` holds the composed characters. For each of them and the empty text, ``states`` has
    what the text up to there has: total tokens; the last piece's kind, its first byte, its
    characters (of a short one) and the tokens before it; and the number of bytes.
    """

    def __init__(self, bpe: WordPrefixes, rules: Rules):
        self.bpe, self.rules = bpe, rules
        self.texts: list[str] = []
        self.states: list[tuple] = [(0, "W", 0, "", 0, 0, 0)]
        self.bytes: list[str] = []
        # By end, of the piece that has the byte before: the last token and the count.
        self.last, self.count = [""], [0]

    def counts(self, text: str) -> np.ndarray:
        out = np.zeros(len(text) + 1, np.int64)
        for i, c in enumerate(text, 1):
            self.add(c)
            out[i] = self.states[-1][0]
        return out

    def add(self, c: str) -> None:
        """One more character of the text, as it is before composing."""
        texts, ccc = self.texts, unicodedata.combining
        keep = len(texts)
        if texts and not self.rules.begins(c):
            of = ccc(c)
            if not of:
                keep -= 1
            elif ccc(texts[-1]) != of or len(unicodedata.normalize("NFD", c)) > 1:
                # What may join or change places: from the last character that isn't a mark.
                keep -= 1
                while keep and ccc(texts[keep]):
                    keep -= 1
        new = self.rules.compose("".join(texts[keep:]) + c)
        same = 0
        while keep + same < len(texts) and same < len(new) and texts[keep + same] == new[same]:
            same += 1
        self.back(keep + same)
        for x in new[same:]:
            state = self.states[-1]
            for y, kind, data in self.rules.lowered(x):
                state = self.step(state, y, kind, data)
            self.texts.append(x)
            self.states.append(state)

    def back(self, n: int) -> None:
        del self.texts[n:], self.states[n + 1 :]
        size = self.states[-1][-1]
        del self.bytes[size:], self.last[size + 1 :], self.count[size + 1 :]

    def step(self, state: tuple, c: str, kind: str, data: bytes) -> tuple:
        total, piece, start, chars, before, sign, size = state
        if kind == "W":
            return (total, "W", size, "", total, 0, size)
        # "'s" and the like are pieces of their own; "'r" is two as long as no e follows. ``sign``
        # is 1 more than the tokens before an apostrophe that stands as a piece before one letter.
        short = piece == "S" and chars == "'" and c in ("s", "t", "m", "d")
        long = bool(sign) and chars + c in ("re", "ve", "ll")
        if short or long:
            whole, before = ("'" + c, before) if short else ("'" + chars + c, sign - 1)
            symbols = [self.bpe.byte[b] for b in whole.encode()]
            symbols[-1] += self.bpe.end
            self.bytes.append(self.bpe.byte[data[0]])
            self.last.append("")
            self.count.append(0)
            total = before + len(self.bpe.merged(symbols))
            return (total, "C", size, whole, before, 0, size + 1)
        if kind == piece and kind != "N":
            chars, sign = (chars + c)[:3], 0
        else:
            sign = before + 1 if piece == "S" and chars == "'" and kind == "L" else 0
            piece, start, chars, before = kind, size, c, total
        for b in data:
            self.byte(start, self.bpe.byte[b])
        return (before + self.closed(start), piece, start, chars, before, sign, size + len(data))

    def byte(self, start: int, b: str) -> None:
        """The last token and the count of the piece with one more byte, if others follow."""
        bpe, s, last, count = self.bpe, self.bytes, self.last, self.count
        s.append(b)
        i = len(s)
        tail = "".join(s[max(start, i - bpe.reach.get(b, 1)) : i])
        for n in range(1, len(tail) + 1):
            t = tail[-n:]
            if t in bpe.vocab and bpe.stands("", t, False) and bpe.stands(last[i - n] if i - n > start else "", t, False):
                last.append(t)
                count.append((count[i - n] if i - n > start else 0) + 1)
                return
        raise ValueError(f"no token ends {tail!r}")

    def closed(self, start: int) -> int:
        """Tokens of the piece if it ends here."""
        bpe, s = self.bpe, self.bytes
        i = len(s)
        tail = "".join(s[max(start, i - bpe.reach_end.get(s[-1], 1)) : i])
        for n in range(1, len(tail) + 1):
            t = tail[-n:]
            if t + bpe.end in bpe.vocab and bpe.stands("", t, True) and bpe.stands(self.last[i - n] if i - n > start else "", t, True):
                return (self.count[i - n] if i - n > start else 0) + 1
        raise ValueError(f"no token ends {tail!r}")


def prefix_tables(docs: DataFrame, tokenizer: str = "word_bpe_49k.json") -> DataFrame:
    """The stored tables of whole texts: doc_id, n_bytes (UTF-8), steps (binary, a byte a character).

    `total`, `longest` and `counts` read them; no text is encoded again. A null text counts as
    empty and has an empty table. doc_id may be of any type and null. Repeated rows give repeated tables; an empty table of documents
    an empty one. Other columns aren't read.
    """

    def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = loaded(PrefixCounts, tokenizer)
        for batch in (b.slice(i, ROWS) for b in batches for i in range(0, b.num_rows, ROWS)):
            steps = pa.array([table.steps(t) for t in batch.column("text").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), steps], ["doc_id", "n_bytes", "steps"])
        release()

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    return rows.mapInArrow(tables, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_bytes long, steps binary")


def count_tokens(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", limit: int = 2048) -> DataFrame:
    """Tokens of every whole text: doc_id, n_bytes, n_tokens, over_limit, fitting_chars, steps.

    All come from the text's prefix table, ``steps``: n_tokens is its last count, fitting_chars
    the longest prefix, in characters, that has at most ``limit`` tokens. A null text counts as
    empty: 0 of all. Each row is counted by itself; repeated rows give repeated results.

    Words of letters up to U+024F are kept by a worker and looked up. Others go through the table a
    character at a time, and long ones aren't kept: texts of other scripts, above all without
    white space, take more than ten times as long. A run of combining marks of alternating
    classes without a base takes time that grows with its square.
    """
    return answers(prefix_tables(docs, tokenizer), limit)


def answers(tables: DataFrame, limit: int = 2048) -> DataFrame:
    """``tables`` with n_tokens, over_limit and fitting_chars, for any limit, from the steps alone."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            steps = [x.as_buffer() for x in batch.column("steps")]
            n = [total(x) for x in steps]
            fitting = [len(x) if k <= limit else longest(x, limit) for x, k in zip(steps, n, strict=True)]
            n = pa.array(n, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), n, pc.greater(n, limit), pa.array(fitting, pa.int64()), batch.column("steps")], ["doc_id", "n_bytes", "n_tokens", "over_limit", "fitting_chars", "steps"])

    return tables.mapInArrow(read, f"doc_id {tables.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long, over_limit boolean, fitting_chars long, steps binary")
