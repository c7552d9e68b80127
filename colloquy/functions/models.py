"""Hooks for outside models: a user's function over whole batches, made once for each task, tried again if it fails.

The stubs that come with them are deterministic and stand where a model would.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from colloquy.functions.arrow import arrow

#: A few common words of each language, for the stub.
COMMON = {"de": {"der", "die", "und", "das", "ist", "nicht"}, "en": {"the", "and", "of", "to", "is", "that"}, "es": {"el", "los", "que", "las", "una", "por"}, "fr": {"le", "les", "des", "est", "une", "dans"}}


def model_hook(make: Callable[[], Callable], returns: str, attempts: int = 2) -> Callable[..., Column]:
    """A column function of a model.

    ``make`` loads the model, once for each task; what it gives maps a batch (a pandas Series) to a Series, or to a
    DataFrame for a struct. A batch that fails is tried again, ``attempts`` times in all; after that the query fails.
    """

    def tried(model, batch):
        for left in range(attempts - 1, -1, -1):
            try:
                return model(batch)
            except Exception:
                if not left:
                    raise

    if returns.startswith("struct"):

        def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            model = make()
            for batch in batches:
                yield tried(model, batch)

    else:

        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            model = make()
            for batch in batches:
                yield tried(model, batch)

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame if returns.startswith("struct") else pd.Series]}
    return lambda column: F.pandas_udf(run, returns)(column)


def hear(text: pd.Series) -> pd.DataFrame:
    """Stub of a speech model: the words as they are; the longer, the surer."""
    heard = text.fillna("").map(lambda t: " ".join(t.split()))
    size = heard.map(lambda t: len(t.encode()))
    return pd.DataFrame({"text": heard, "confidence": np.minimum(size / 100, 0.9) + 0.1, "is_partial": size < 50})


def vote(text: pd.Series) -> pd.DataFrame:
    """Stub of a language detector: a vote of common words; a tie or no vote has no language."""

    def one(t):
        words = re.findall(r"[^\W\d_]+", (t or "").lower())
        votes = sorted(((sum(w in c for w in words), lang) for lang, c in COMMON.items()), reverse=True)
        return (votes[0][1], votes[0][0] >= 3) if votes[0][0] > votes[1][0] else (None, False)

    return pd.DataFrame(text.map(one).tolist(), columns=["lang", "reliable"])


def first_sentence(text: pd.Series) -> pd.DataFrame:
    """Stub of a language model: the first sentence."""
    short = text.fillna("").map(lambda t: re.split(r"(?<=[.?!])\s", t.strip())[0])
    return pd.DataFrame({"content": short, "truncated": text.fillna("").str.len() > short.str.len()})


transcribe = model_hook(lambda: hear, "struct<text:string,confidence:double,is_partial:boolean>")
detect_language = model_hook(lambda: vote, "struct<lang:string,reliable:boolean>")
summarise = model_hook(lambda: first_sentence, "struct<content:string,truncated:boolean>")


@arrow("double")
def spread(v: pd.Series) -> float:
    return float(v.max() - v.min())
