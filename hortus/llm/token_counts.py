"""Token counts with a shortcut for words that are one token."""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

#: Pre-token texts whose counts a worker remembers; beyond it the memory is cleared, counts do not change.
REMEMBERED, LONGEST = 1 << 18, 64


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    out, extra = [""] * 256, 0
    for b in range(256):
        out[b] = chr(b) if b in plain else chr(256 + extra)
        extra += b not in plain
    return out


class Counter:
    """Counts tokens of whole texts as the library does for a lower-casing, byte-level vocabulary with word ends."""

    def __init__(self, spec: str, whole: frozenset[str]):
        model = json.loads(spec)
        self.model = Tokenizer.from_str(spec).model
        self.letters = byte_letters()
        pattern = model["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.words = regex.compile(pattern)
        special = sorted((t["content"] for t in model["added_tokens"]), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.whole, self.known = whole, dict.fromkeys(whole, 1)

    def merged(self, word: str) -> int:
        return len(self.model.tokenize("".join([self.letters[b] for b in word.encode("utf-8", "surrogatepass")])))

    def pre_tokens(self, text: str) -> list[str]:
        text = unicodedata.normalize("NFC", text)
        # The library lowers letter by letter; only a final sigma differs from str.lower.
        return self.words.findall("".join(map(str.lower, text)) if "Σ" in text else text.lower())

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        parts = self.special.split(text) if self.special else [text]
        total, known = len(parts) - 1, self.known
        for part in parts:
            for word in self.pre_tokens(part):
                n = known.get(word)
                if n is None:
                    n = self.merged(word)
                    if len(word) <= LONGEST:
                        if len(known) > REMEMBERED + len(self.whole):
                            known = self.known = dict.fromkeys(self.whole, 1)
                        known[word] = n
                total += n
        return total


def whole_words(spec: str) -> frozenset[str]:
    """The vocabulary strings that, alone, are one pre-token and encode as one token.

    Proven by encoding each with the library; bounded by the vocabulary."""
    tokenizer = Tokenizer.from_str(spec)
    model = json.loads(spec)["model"]
    back = {c: b for b, c in enumerate(byte_letters())}
    end, texts = model.get("end_of_word_suffix") or "", []
    for piece in model["vocab"]:
        core = piece[:len(piece) - len(end)] if end and piece.endswith(end) else None
        if core and all(c in back for c in core):
            try:
                texts.append(bytes(back[c] for c in core).decode("utf-8"))
            except UnicodeDecodeError:
                continue
    counter, out = Counter(spec, frozenset()), []
    for i in range(0, len(texts), 4096):
        part = texts[i:i + 4096]
        for text, code in zip(part, tokenizer.encode_batch(part, add_special_tokens=False)):
            if len(code.ids) == 1 and counter.pre_tokens(text) == [text]:
                out.append(text)
    return frozenset(out)


def token_counts(docs: DataFrame, path: str, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row.

    ``path``: the vocabulary file, read by the driver and broadcast with the
    proven words (both bounded by the vocabulary).  Special strings inside a
    text are one token each, as by default.  Null and empty texts count 0;
    repeated rows are counted alike; an empty table gives no rows; other
    columns are not looked at."""
    with open(path, encoding="utf-8") as f:
        spec = f.read()
    shared = docs.sparkSession.sparkContext.broadcast((spec, whole_words(spec)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counter = Counter(*shared.value)
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "n_bytes": batch["n_bytes"],
                                "n_tokens": [counter.count(t) for t in batch["text"]]})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"), "text")
    return (rows.mapInPandas(run, "doc_id long, n_bytes long, n_tokens long")
            .withColumn("over_limit", F.col("n_tokens") > limit))
