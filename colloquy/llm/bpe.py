"""Byte-pair encoding and decoding by a tokenization automaton.

The automaton reads tokens: its state is the last token read, and an arc leads on to every token that the merges would
really leave after it. It is built by merge gadgets, one for each merge in turn: the gadget of ``u v -> uv`` takes the
arc ``v`` from the state behind ``u``, and adds the arc ``uv`` wherever ``u`` and then ``v`` could be read, to a state
that is a copy of the one behind ``v``. The copies share what they inherit, so the construction keeps, for each pair
taken apart, the number of the gadget; whether an arc is left is then read off the two tokens' chains of halves.
Exactly one path spells each word. It is found by table-driven steps: a trie over reversed tokens lists the tokens that
end at a place, and the last token of the path is the one whose arc from the path so far exists. Decoding emits labels.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from array import array
from functools import cached_property, lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

#: Most words that a Python worker keeps; the table is emptied beyond it.
WORDS_KEPT = 500_000


def byte_letters() -> list[str]:
    """The letter that byte-level vocabularies write for each byte: itself where visible, else one from 256 on."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in seen else chr(next(rest)) for b in range(256)]


class Automaton:
    """Tokenization automaton of one list of merges over byte letters."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], end_of_word: str = ""):
        self.end_of_word = end_of_word
        self.vocab = vocab
        self.labels = {i: t for t, i in vocab.items()}
        self.letter = byte_letters()
        self.byte_of = {c: b for b, c in enumerate(self.letter)}
        self.halves: dict[int, tuple[int, int]] = {}
        self.made: dict[int, int] = {}
        self.gadget: dict[tuple[int, int], int] = {}
        for number, (left, right) in enumerate(merges):
            u, v, uv = vocab[left], vocab[right], vocab[left + right]
            self.gadget.setdefault((u, v), number)
            if uv not in self.made:
                self.halves[uv], self.made[uv] = (u, v), number
        self.root: dict = {}
        for token, i in vocab.items():
            if i in self.made or len(self.split_letters(token)) == 1:
                self.add(token, i)
        self.open: dict[tuple[int, int], bool] = {}

    def split_letters(self, token: str) -> list[str]:
        """Letters, the last one with the end-of-word mark if the token has it."""
        end = self.end_of_word
        if end and token.endswith(end) and len(token) > len(end):
            body = list(token[: -len(end)])
            body[-1] += end
            return body
        return list(token)

    def add(self, token: str, i: int) -> None:
        node = self.root
        for letter in reversed(self.split_letters(token)):
            node = node.setdefault(letter, {})
        node[""] = i

    def arc(self, x: int, y: int) -> bool:
        """Is the arc y left in the state behind x?"""
        known = self.open.get((x, y))
        if known is None:
            known = True
            left, copied = x, 1 << 60
            while known:
                right, added = y, 1 << 60
                while True:
                    taken = self.gadget.get((left, right))
                    # taken before the state was copied and the longer arc was added; twice the same token joins from the left
                    if taken is not None and taken < copied and taken <= added:
                        known = False
                        break
                    if right not in self.halves:
                        break
                    added, right = self.made[right], self.halves[right][0]
                if left not in self.halves:
                    break
                copied, left = self.made[left], self.halves[left][1]
            if len(self.open) > 2_000_000:
                self.open.clear()
            self.open[(x, y)] = known
        return known

    def encode(self, letters: list[str]) -> list[int]:
        """Token ids of one word, given as letters."""
        n = len(letters)
        last = [-1] * (n + 1)  # the last token of the path that spells the first i letters, and its length
        size = [0] * (n + 1)
        for i in range(1, n + 1):
            node, j, found = self.root, i, False
            while j > 0:
                node = node.get(letters[j - 1])
                if node is None:
                    break
                j -= 1
                token = node.get("")
                if token is not None and (j == 0 or (last[j] >= 0 and self.arc(last[j], token))):
                    last[i], size[i], found = token, i - j, True
                    break
            if not found:
                last[i], size[i] = -1, 1
        out, i = [], n
        while i > 0:
            if last[i] >= 0:
                out.append(last[i])
            i -= size[i]
        return out[::-1]


#: Texts of these characters alone are split by the patterns below; Unicode tables of all libraries agree on them.
PLAIN_TEXT = re.compile(r"[\x09\x0a\x20-\x7e\u00a1-\u012f\u0131-\u017f\u2010-\u2027\u2030-\u205e\u20a0-\u20bf]*")
_LETTERS = "".join(f"\\u{c:04x}" for c in range(0x24F + 1) if unicodedata.category(chr(c))[0] == "L")
_NUMBERS = "".join(f"\\u{c:04x}" for c in range(0x24F + 1) if unicodedata.category(chr(c))[0] == "N")
_SUFFIX = "'s|'t|'re|'ve|'m|'ll|'d"


class WordTokenizer:
    """Encodes and decodes as the tokenizers library does for a byte-level BPE file, by the automaton."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.library = Tokenizer.from_file(path)
        model = spec["model"]
        self.path = path
        self.end = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = {i: t for t, i in self.special.items()}
        self.cut = re.compile("|".join(map(re.escape, self.special))) if self.special else None
        if self.end:
            self.words = re.compile(f"{_SUFFIX}|[{_LETTERS}]+|[{_NUMBERS}]|[^\\s{_LETTERS}{_NUMBERS}]+")
        else:
            self.words = re.compile(f"{_SUFFIX}| ?[{_LETTERS}]+| ?[{_NUMBERS}]+| ?[^\\s{_LETTERS}{_NUMBERS}]+|\\s+(?!\\S)|\\s+")
        self.byte_level = self.library.decoder is not None
        self.table = _Table(self)

    @cached_property
    def automaton(self) -> Automaton:
        """Built when a word is first encoded or decoded."""
        with open(self.path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        return Automaton(model["vocab"], merges, self.end)

    def encode_letters(self, letters: list[str]) -> list[int]:
        if self.end and letters:
            letters[-1] += self.end
        return self.automaton.encode(letters)

    def encode_plain(self, text: str) -> list[int]:
        """Ids of a text that is a part between cuts and of plain characters."""
        letter = self.automaton.letter
        return [i for w in self.words.findall(text) for i in self.encode_letters([letter[b] for b in w.encode()])]

    def encode_any(self, text: str) -> list[int]:
        """Ids of any text without special tokens, split by the library."""
        if self.library.normalizer is not None:
            text = self.library.normalizer.normalize_str(text)
        return [i for w, _ in self.library.pre_tokenizer.pre_tokenize_str(text) for i in self.encode_letters(list(w))]

    def chunks(self, text: str) -> list[str] | None:
        """Pieces at whose borders words always end; None if the text isn't plain."""
        if PLAIN_TEXT.fullmatch(text) is None:
            return None
        if self.end:
            return unicodedata.normalize("NFC", text).lower().split()
        if "  " in text or " \n" in text or "\n " in text or "\t" in text:
            return re.findall(r" ?\S+|\s+(?!\S)|\s+", text)
        first, *rest = text.split(" ")
        return ([first] if first else []) + [" " + x for x in rest]

    def entries(self, text: str) -> list[tuple]:
        """(decimal ids, labels or None, ids as little-endian 32-bit numbers) of each piece in turn."""
        out: list[tuple] = []
        at, cuts = 0, [(m.start(), m.end(), m.group()) for m in self.cut.finditer(text)] if self.cut and "<" in text else []
        for start, end, name in [*cuts, (len(text), len(text), "")]:
            if part := text[at:start]:
                found = self.chunks(part)
                if found is None:
                    out.append(self.entry(self.encode_any(part)))
                else:
                    out += map(self.table.__getitem__, found)
            if name:
                out.append(self.entry([self.special[name]]))
            at = end
        return out

    def entry(self, ids: list[int]) -> tuple:
        if self.byte_level:
            return None, None, array("I", ids).tobytes()
        return " ".join(map(str, ids)), self.decode(ids), b""

    def encode(self, text: str) -> list[int]:
        found = self.entries(text)
        if self.byte_level:
            return list(array("I", b"".join([e[2] for e in found])))
        return [int(i) for e in found for i in e[0].split()]

    def decode(self, ids: list[int]) -> str:
        """Emits the arcs' labels: joined by blanks, or their bytes if the file has a byte-level decoder."""
        names, labels = self.names, self.automaton.labels
        tokens = [names[i] if i in names else labels[i] for i in ids]
        if not self.byte_level:
            return " ".join(tokens)
        raw = self.automaton.byte_of
        return b"".join(t.encode() if i in names else bytes(raw[c] for c in t) for i, t in zip(ids, tokens)).decode("utf-8", "replace")


class _Table(dict):
    """Entries of pieces, filled as they come and emptied when full."""

    def __init__(self, tokenizer: WordTokenizer):
        super().__init__()
        self.tokenizer = tokenizer

    def __missing__(self, piece: str) -> tuple:
        if len(self) >= WORDS_KEPT:
            self.clear()
        value = self[piece] = self.tokenizer.entry(self.tokenizer.encode_plain(piece))
        return value


@lru_cache(maxsize=4)
def tokenizer(path: str) -> WordTokenizer:
    """One for each Python worker and file."""
    return WordTokenizer(path)


def encode_decode(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", texts: bool = False) -> DataFrame:
    """Encodes every whole text and decodes it again; one row for each row, nothing is shuffled.

    Columns: the id, n_tokens, ids_sha256, decoded_sha256, and with ``texts`` also ids (array) and decoded.
    Null and empty texts have no tokens and decode to the empty text. Ids may be null or repeated; other columns are ignored.
    ``tokenizer_path`` names a file that every node has.
    """
    kept = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    fields = [("doc_id", kept.schema["doc_id"].dataType.simpleString()), ("n_tokens", "bigint"), ("ids_sha256", "string"), ("decoded_sha256", "string")]
    if texts:
        fields += [("ids", "array<bigint>"), ("decoded", "string")]

    def run(batches):
        tok = tokenizer(tokenizer_path)
        sha = hashlib.sha256
        for batch in batches:
            counts, ids_sha, text_sha, all_ids, all_text = [], [], [], [], []
            for text in batch.column("text"):
                found = tok.entries(text.as_py() or "")
                if tok.byte_level:
                    numbers = list(array("I", b"".join([e[2] for e in found])))
                    ids, decoded = " ".join(map(str, numbers)), tok.decode(numbers)
                else:
                    ids = " ".join([e[0] for e in found if e[0]])
                    decoded = " ".join([e[1] for e in found if e[0]])
                counts.append(ids.count(" ") + 1 if ids else 0)
                ids_sha.append(sha(ids.encode()).hexdigest())
                text_sha.append(sha(decoded.encode()).hexdigest())
                if texts:
                    all_ids.append([int(i) for i in ids.split()])
                    all_text.append(decoded)
            columns = [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]
            if texts:
                columns += [pa.array(all_ids, pa.list_(pa.int64())), pa.array(all_text, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, [f[0] for f in fields])

    return kept.mapInArrow(run, ", ".join(f"{n} {t}" for n, t in fields))
