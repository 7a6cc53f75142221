"""SentencePiece BPE encoding by a prefix table of last tokens, and decoding.

A merge encoding has a property that makes greedy merging unnecessary: the last token of the encoding of a prefix is
unique, and it is the one token ending there that is *compatible* with the last token of the prefix before it. So one
pass with an automaton over the pieces fills a table ``last[i]``, and the ids follow from the end backwards. Two tokens
are compatible when merging their joined strings never merges across the border between them; ``compatible`` decides
that from the two tokens' own merge trees.

Texts are cut where no piece of the model can cross (before each blank: pieces have their blank marks in front only;
inside words between two characters that are neighbours in no piece), and distinct parts are encoded once.

Defined results: a null or empty text has the end id only and decodes to the empty text; runs of blanks, control
characters, characters outside the model (byte pieces) and texts of any length follow the library exactly; repeated
rows give repeated rows; extra columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import WordCache, give_back, prepare
from .segments import coded_segments

MARK = "▁"
NEVER = 1 << 60
#: Bytes of word parts kept between batches, and pairs of tokens whose compatibility is kept.
CACHE, PAIRS = 96 << 20, 500_000
#: Stretches of word characters and of others; where a piece may join two, ``cut`` joins them again.
CHUNKS = re.compile(r"[\w▁]+|[^\w▁]+").findall


class PieceCodec:
    """Encode and decode as the SentencePiece library does for a BPE model with identity normalisation."""

    def __init__(self, model_path: str):
        import ahocorasick
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        size = model.get_piece_size()
        self.eos = model.eos_id()
        self.byte_ids = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.piece = [model.id_to_piece(i) for i in range(size)]
        self.byte_of = {i: b for b, i in enumerate(self.byte_ids)}
        self.silent = {i for i in range(size) if model.is_control(i)}
        normal = [i for i in range(size) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        self.id_of = {self.piece[i]: i for i in normal}
        # pieces of blank marks only come last of all merges and tie with one another; they are settled after the rest
        self.runs = {len(p): i for p, i in self.id_of.items() if len(p) > 1 and not p.strip(MARK)}
        merged = sorted((i for i in normal if len(self.piece[i]) > 1 and self.piece[i].strip(MARK)), key=lambda i: -model.get_score(i))
        scores = [model.get_score(i) for i in merged]
        run_scores = {model.get_score(i) for i in self.runs.values()}
        if len(set(scores)) != len(scores) or any(MARK in self.piece[i][1:] for i in merged) or (run_scores and (len(run_scores) > 1 or max(run_scores) >= min(scores))):
            raise ValueError("the model's merges tie or cross blanks; this codec needs ranked merges inside words")
        if model.encode("a  b") != model.encode("a  b", add_bos=False) or model.encode(" a") == model.encode("a"):
            raise ValueError("the model drops or rewrites blanks; this codec needs identity normalisation")
        self.rank = {self.piece[i]: r for r, i in enumerate(merged)}
        self.parts: dict[str, tuple[str, str]] = {}
        self.automaton = ahocorasick.Automaton()
        joined: set[str] = set()
        for i in merged:
            token = self.piece[i]
            if (halves := self._last_merge(token)) is not None:
                self.parts[token] = halves
                self.automaton.add_word(token, token)
                joined.update(a + b for a, b in zip(token, token[1:]))
        self.automaton.make_automaton()
        self.joined = joined
        self.pairs: dict[tuple[str, str], bool] = {}
        self.known: dict[str, tuple[int, str, str]] = WordCache(CACHE)

    def _last_merge(self, token: str) -> tuple[str, str] | None:
        """The two halves whose merge makes ``token``, or None if merging its characters ends elsewhere."""
        symbols, rank, halves = list(token), self.rank, None
        while len(symbols) > 1:
            best, at = NEVER, -1
            for k in range(len(symbols) - 1):
                r = rank.get(symbols[k] + symbols[k + 1], NEVER)
                if r < best:
                    best, at = r, k
            if at < 0:
                return None
            halves = (symbols[at], symbols[at + 1])
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
        return halves

    def compatible(self, left: str, right: str) -> bool:
        """Whether ``left`` and ``right`` stay apart when their joined characters are merged.

        Goes back in time along the border: whichever neighbour was formed last is undone, and the two symbols that
        touched before must not have had a merge that was due earlier than the one just undone. Equal merges run
        from left to right, so one undone on the right also loses a tie to the border.
        """
        key = (left, right)
        known = self.pairs.get(key)
        if known is not None:
            return known
        rank, parts = self.rank, self.parts
        due, answer = NEVER, True
        while True:
            if rank.get(left + right, NEVER) < due:
                answer = False
                break
            made_left = rank[left] if left in parts else -1
            made_right = rank[right] if right in parts else -1
            if made_left < 0 and made_right < 0:
                break
            if made_left > made_right:
                due, left = made_left, parts[left][1]
            else:
                due, right = made_right + 1, parts[right][0]
        if len(self.pairs) > PAIRS:
            self.pairs.clear()
        self.pairs[key] = answer
        return answer

    def _last_tokens(self, part: str, last: list[str], done: int) -> None:
        """Fill ``last[i]`` for every prefix length i over ``done``; what stands up to there holds for ``part`` too."""
        known, at = self.pairs.get, done
        for end, token in self.automaton.iter(part):
            end += 1
            if end <= done or last[end]:
                continue
            start = end - len(token)
            while at < start:  # prefixes that no longer token ends
                at += 1
                if not last[at]:
                    last[at] = part[at - 1]
            if not start:
                last[end] = token
                continue
            before = last[start]
            fits = known((before, token))
            if fits or (fits is None and self.compatible(before, token)):
                last[end] = token
        for at in range(at + 1, len(part) + 1):
            if not last[at]:
                last[at] = part[at - 1]

    def _backwards(self, last: list[str]) -> list[int]:
        found: list[int] = []
        at = len(last) - 1
        while at:
            token = last[at]
            known = self.id_of.get(token)
            if known is None:
                found.extend(self.byte_ids[b] for b in reversed(token.encode()))
            else:
                found.append(known)
            at -= len(token)
        found.reverse()
        return found

    def learn(self, parts: set[str]) -> dict[str, list[int]]:
        """Ids of parts. In sorted order a part shares the table of its common prefix with the part before."""
        out: dict[str, list[int]] = {}
        before, last = "", [""]
        for part in sorted(parts):
            shared, most = 0, min(len(part), len(before))
            while shared < most and part[shared] == before[shared]:
                shared += 1
            last = last[: shared + 1] + [""] * (len(part) - shared)
            self._last_tokens(part, last, shared)
            out[part] = self._backwards(last)
            before = part
        return out

    def cut(self, marked: str) -> list[str]:
        """A marked word's parts, between which no piece of the model reaches."""
        parts = CHUNKS(marked)
        if len(parts) == 1:
            return parts
        out, joined = [parts[0]], self.joined
        for part in parts[1:]:
            if out[-1][-1] + part[0] in joined:
                out[-1] += part
            else:
                out.append(part)
        return out

    def encode_word(self, word: str) -> list[int]:
        """Ids of one blank mark and the word after it."""
        parts = self.cut(MARK + word)
        ids = self.learn(set(parts))
        return [i for part in parts for i in ids[part]]

    def encode_run(self, marks: int) -> list[int]:
        """Ids of blank marks that no word has taken: equal merges, leftmost first, so what is done on the left stays a stack."""
        done: list[int] = []
        runs = self.runs
        for _ in range(marks):
            done.append(1)
            while len(done) > 1 and done[-2] + done[-1] in runs:
                last = done.pop()
                done[-1] += last
        return [runs[n] if n > 1 else self.id_of[MARK] for n in done]

    def encode(self, text: str | None) -> list[int]:
        """Ids of a whole text, without an end id."""
        if not text:
            return []
        ids: list[int] = []
        waiting = 0
        for word in text.replace(MARK, " ").split(" "):
            if not word:
                waiting += 1
                continue
            got = self.encode_word(word)
            if waiting:
                if got[0] == self.id_of[MARK]:
                    waiting, got = waiting + 1, got[1:]
                ids += self.encode_run(waiting)
                waiting = 0
            ids += got
        return ids + self.encode_run(waiting) if waiting else ids

    def decode(self, ids: list[int]) -> str:
        """The text of ids: pieces joined, byte pieces as UTF-8, the first blank mark dropped."""
        return self._joined(ids)[1:] if self._leads(ids) else self._joined(ids)

    def _leads(self, ids: list[int]) -> bool:
        first = next((i for i in ids if i not in self.silent), None)
        return first is not None and first not in self.byte_of and self.piece[first].startswith(MARK)

    def _joined(self, ids: list[int]) -> str:
        out: list[str] = []
        raw = bytearray()
        for i in ids:
            if i in self.byte_of:
                raw.append(self.byte_of[i])
                continue
            if raw:
                out.append(raw.decode("utf-8", "replace"))
                raw.clear()
            if i not in self.silent:
                out.append(self.piece[i].replace(MARK, " "))
        if raw:
            out.append(raw.decode("utf-8", "replace"))
        return "".join(out)

    def facts(self, words: list[str]) -> tuple[list[int], list[str], list[str]]:
        """Of each word with its blank mark: number of ids, ids as text, decoded text."""
        cuts = [self.cut(MARK + w) if w else [] for w in words]
        known = self.known
        fresh = {part for parts in cuts for part in parts if part not in known}
        known.make_room(fresh, (part for parts in cuts for part in parts))
        fresh = {part for parts in cuts for part in parts if part not in known}
        new = {part: (len(ids), " ".join(map(str, ids)), self._joined(ids)) for part, ids in self.learn(fresh).items()}
        known.update(new)
        counts, as_ids, as_text = [], [], []
        for parts in cuts:
            if len(parts) == 1:
                n, ids, text = known[parts[0]]
            else:
                found = [known[part] for part in parts]
                n, ids, text = sum(f[0] for f in found), " ".join([f[1] for f in found]), "".join([f[2] for f in found])
            counts.append(n)
            as_ids.append(ids)
            as_text.append(text)
        for part in [part for part in new if len(part) > 64]:
            del known[part]
        return counts, as_ids, as_text

    def batch(self, texts: pa.Array) -> Iterator[tuple[int, str, str]]:
        """Per text: number of ids, ids as text (no end id), decoded text."""
        texts = pc.replace_substring(pc.fill_null(texts, ""), MARK, " ")
        offsets, codes, words = coded_segments(texts)
        if len(offsets) < 2:
            return
        counts, as_ids, as_text = self.facts(words)
        empty = np.array([not w for w in words], dtype=bool)
        blank = np.add.reduceat(empty[codes], offsets[:-1])
        totals = np.add.reduceat(np.array(counts, dtype=np.int64)[codes], offsets[:-1])
        for k in range(len(offsets) - 1):
            if blank[k]:
                ids = self.encode(texts[k].as_py())
                yield len(ids), " ".join(map(str, ids)), self.decode(ids)
            else:
                own = codes[offsets[k] : offsets[k + 1]].tolist()
                yield int(totals[k]), " ".join([as_ids[c] for c in own]), "".join([as_text[c] for c in own])[1:]


_loaded: dict[str, PieceCodec] = {}


def codec(model_path: str) -> PieceCodec:
    """The codec of this worker process, made once."""
    if model_path not in _loaded:
        _loaded[model_path] = PieceCodec(model_path)
    return _loaded[model_path]


def encode_decode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", digests_only: bool = False) -> DataFrame:
    """Encode each text with an end id, then decode the ids.

    Returns ``id_col, n_tokens, ids (array<int>), decoded`` or, with ``digests_only``, the SHA-256 of the decimal ids
    joined by blanks and of the decoded text in their place, so that the ids need not leave the worker.
    """
    prepare(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    tail = "ids_sha256 string, decoded_sha256 string" if digests_only else "ids array<int>, decoded string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model_path)
        give_back()
        for batch in batches:
            counts, first, second = [], [], []
            for n, ids, text in own.batch(batch.column(1)):
                ids = f"{ids} {own.eos}" if n else str(own.eos)
                counts.append(n + 1)
                if digests_only:
                    first.append(hashlib.sha256(ids.encode()).hexdigest())
                    second.append(hashlib.sha256(text.encode()).hexdigest())
                else:
                    first.append(list(map(int, ids.split(" "))))
                    second.append(text)
            firsts = pa.array(first, pa.string() if digests_only else pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), firsts, pa.array(second, pa.string())], ["id", "n", "a", "b"])

    out = docs.select(docs[id_col], docs[text_col]).mapInArrow(run, f"id {kind}, n bigint, {tail.replace('ids_sha256', 'a').replace('decoded_sha256', 'b').replace('ids array', 'a array').replace('decoded string', 'b string')}")
    names = ["ids_sha256", "decoded_sha256"] if digests_only else ["ids", "decoded"]
    return out.toDF(id_col, "n_tokens", *names)
