"""Answers to questions from the evidence that a search found, whole or piece by piece."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.functions.text import CONTENT_STOPWORDS
from parlance.operators import search

EVIDENCE, CITED_BY_DEFAULT, CITED_WITHOUT_MODEL = 10, 3, 5
_CITED = re.compile(r"\[(msg_[\w\-]+)\]")
_WORD = re.compile(r"[A-Za-z][A-Za-z']+")


def rephrased(query: str, complete: Callable[[str], str] | None) -> str:
    """The query in a model's words; as it is without a model, or if it has five telling words."""
    telling = {w for w in _WORD.findall(query.lower()) if w not in CONTENT_STOPWORDS}
    return query if complete is None or len(telling) >= 5 else complete(f"Rephrase for search: {query}").strip() or query


def evidence(hits: DataFrame, query: str) -> list[dict]:
    """At most ten hits, those first whose emotion the query prefers; hits: query_id, rank, msg_id, sender, content, similarity, emotion_label."""
    rows = search.rerank(hits, query, EVIDENCE).orderBy("rank")
    return [r.asDict() for r in rows.select("msg_id", "sender", F.substring("content", 1, 240).alias("content"), "similarity").limit(EVIDENCE).collect()]


def _prompt(query: str, found: list[dict]) -> str:
    return "\n".join([f"Question: {query}", "Evidence:", *(f"[{e['msg_id']}] {e['sender']}: {e['content']}" for e in found)])


def _cited(text: str, found: list[dict]) -> list[str]:
    known = [e["msg_id"] for e in found]
    out = [i for i in dict.fromkeys(_CITED.findall(text)) if i in known]
    return out or known[:CITED_BY_DEFAULT]


def _plain(found: list[dict]) -> str:
    """What is said without a model."""
    if not found:
        return "Nothing in this conversation answers that."
    return "The closest messages: " + "; ".join(f"{e['sender']}: {e['content']} [{e['msg_id']}]" for e in found[:CITED_WITHOUT_MODEL])


def answer_stream(hits: DataFrame, query: str, complete: Callable[[str], Iterator[str]] | None = None) -> Iterator[dict]:
    """meta, then delta for each piece, then done; error instead of done if the model fails."""
    found = evidence(hits, query)
    best = max((e["similarity"] for e in found), default=0.0)
    yield {"event": "meta", "evidence": [e["msg_id"] for e in found]}
    pieces = []
    try:
        for piece in complete(_prompt(query, found)) if complete and found else [_plain(found)]:
            pieces.append(piece)
            yield {"event": "delta", "text": piece}
    except Exception as e:
        yield {"event": "error", "message": str(e)}
        return
    text = "".join(pieces)
    cited = _cited(text, found) if complete else [e["msg_id"] for e in found[:CITED_WITHOUT_MODEL]]
    confidence = min(1.0, best + 0.1) if complete and found else best
    yield {"event": "done", "answer": text, "cited": cited, "confidence": confidence}


def answer(hits: DataFrame, query: str, complete: Callable[[str], Iterator[str]] | None = None) -> dict:
    *_, last = answer_stream(hits, query, complete)
    return last
