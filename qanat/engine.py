"""Facade: one-question answering over the batch plans."""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, replace
from datetime import date
from decimal import ROUND_HALF_UP, Decimal
from pathlib import Path

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qanat.config import AnswerConfig, RetrievalConfig
from qanat.functions import answering, prompts, rules, text
from qanat.functions import arabic_rules as ar
from qanat.memo import Memo
from qanat.operators import bm25, dense, fusion, vector_index
from qanat.operators.vector_index import VectorIndex
from qanat.plans import index as search_index
from qanat.plans.retrieval import retrieve
from qanat.session import local


#: Bytes of chunk rows that an engine remembers.
ROWS_BYTES = 64 << 20


class RateLimited(Exception):
    """A generator's model has no quota left."""


def extractive(model: str, system: str, user: str) -> str:
    """Stand-in for a hosted model: the first body line of the context."""
    for line in user.split("\n"):
        if line and not line.startswith(("[", "السياق", "─", "---")):
            return line
    return ""


class AnswerCache:
    """Answers by key with the time they were written, the ``limit`` latest ones; ``clock`` is replaceable."""

    def __init__(self, clock: Callable[[], float] = time.time, limit: int = 10_000):
        self.rows: dict[str, tuple[float, str]] = {}
        self.clock, self.limit = clock, limit

    def get(self, key: str, ttl: int) -> str | None:
        found = self.rows.get(key)
        return found[1] if found and self.clock() - found[0] < ttl else None

    def put(self, key: str, answer: str, **facts) -> None:
        self.rows.pop(key, None)
        self.rows[key] = (self.clock(), answer)
        while len(self.rows) > self.limit:
            del self.rows[next(iter(self.rows))]


class FolderCache:
    """The same in a folder, a JSON file a key: it outlives the process.  Files that cannot be
    read count as absent."""

    def __init__(self, folder: str, clock: Callable[[], float] = time.time):
        self.folder, self.clock = Path(folder), clock
        self.folder.mkdir(parents=True, exist_ok=True)

    def get(self, key: str, ttl: int) -> str | None:
        try:
            row = json.loads((self.folder / f"{key}.json").read_text(encoding="utf-8"))
        except (OSError, ValueError):
            return None
        return row.get("answer") if self.clock() - row.get("ts", 0) < ttl else None

    def put(self, key: str, answer: str, **facts) -> None:
        part = self.folder / f"{key}.{uuid.uuid4().hex}.part"
        part.write_text(json.dumps({"ts": self.clock(), "answer": answer} | facts, ensure_ascii=False), encoding="utf-8")
        part.replace(self.folder / f"{key}.json")


class StoreCache:
    """The same over a ``KeyedStore``, which all machines share.  Answers are appended in segments of ``every``
    (``flush`` writes what is held); more than ``most`` segments are merged."""

    def __init__(self, store, clock: Callable[[], float] = time.time, every: int = 1, most: int = 64):
        self.store, self.clock, self.every, self.most = store, clock, every, most
        self.held: dict[str, tuple] = {}

    def get(self, key: str, ttl: int) -> str | None:
        row = self.held.get(key)
        found = (row[1], row[2]) if row else None
        if found is None and (old := self.store.get(key)) is not None:
            found = (old["ts"], old["answer"])
        return found[1] if found and self.clock() - found[0] < ttl else None

    def put(self, key: str, answer: str, query: str = "", intent: str = "", prompt_v: int = 0, model: str = "") -> None:
        self.held[key] = (key, self.clock(), answer, query, intent, model, prompt_v)
        if len(self.held) >= self.every:
            self.flush()

    def flush(self) -> None:
        if self.held:
            self.store.append(self.store.spark.createDataFrame(list(self.held.values()), self.store.schema).coalesce(1))
            self.held = {}
            if len(self.store.segments()) > self.most:
                self.store.compact()


class Limiter:
    """At most ``limit`` requests of a caller in each window of ``every`` seconds."""

    def __init__(self, limit: int = 20, every: float = 60.0, clock: Callable[[], float] = time.time):
        self.limit, self.every, self.clock = limit, every, clock
        self.window, self.seen = -1, {}

    def allow(self, caller: str) -> bool:
        now = int(self.clock() // self.every)
        if now != self.window:
            self.window, self.seen = now, {}
        self.seen[caller] = self.seen.get(caller, 0) + 1
        return self.seen[caller] <= self.limit


NO_ANSWER = {
    "answer": "", "intent": None, "sources": [], "model": None, "model_fallback": False,
    "cached": False, "cache_reason": "blank", "retrieval_ms": 0, "llm_ms": 0, "n_chunks": 0,
}


def cache_key(model: str, intent: str, chunk_ids: list[str], query: str, config: AnswerConfig = AnswerConfig()) -> str:
    """The same digest as ``functions.answering.cache_key``."""
    body = "\x1f".join([",".join(sorted(chunk_ids)), intent, model, str(config.prompt_version), query.strip().lower()])
    return hashlib.sha256(body.encode()).hexdigest()[:32]


@dataclass
class Engine:
    """``chunks`` has unit, doc, chunk_id, tokens, title, body_clean, text, pub_date, article_type, league, teams, source_url.

    With an ``index`` of them (``qanat.plans.index``) questions read postings of their own
    terms and ``tokens`` is not needed; ``Engine.over`` makes an engine from an index alone.
    """

    chunks: DataFrame
    vectors: DataFrame | VectorIndex | None = None
    embed: Callable | None = None
    rules: rules.RuleSet = field(default_factory=rules.arabic_football)
    folding: text.Folding = text.ARABIC
    generate: Callable[[str, str, str], str] = extractive
    small: str = "small"
    big: str = "big"
    system: str = prompts.RULES
    prompts: dict[str, str] = field(default_factory=lambda: dict(prompts.INTENTS))
    config: AnswerConfig = AnswerConfig()
    retrieval: RetrievalConfig = RetrievalConfig(k_final=6)
    cache: AnswerCache | FolderCache | StoreCache = field(default_factory=AnswerCache)
    now: str | None = None
    index: search_index.Index | None = None
    #: Refuses callers that ask too often.
    limiter: Limiter | None = None
    #: Makes the tokens of a query as those of the chunks were made; folded tokens by default.
    tokenize: Callable[[Column], Column] | None = None

    _columns: list | None = field(default=None, init=False, repr=False, compare=False)
    _picked: list | None = field(default=None, init=False, repr=False, compare=False)
    _boost: tuple | None = field(default=None, init=False, repr=False, compare=False)
    #: Rows of units that questions have met lately.
    _seen: Memo = field(default_factory=lambda: Memo(ROWS_BYTES), init=False, repr=False, compare=False)

    @classmethod
    def over(cls, index: search_index.Index, **more) -> Engine:
        return cls(index.units, index=index, **({"vectors": index.vectors} | more))

    @classmethod
    def serve(cls, spark, path: str, **more) -> Engine:
        """An engine for single questions over the index at ``path``, in a session of its own."""
        return cls.over(search_index.load(search_index.serving(spark), path), **more)

    def tokens(self, query: Column) -> Column:
        return self.tokenize(query) if self.tokenize else text.tokens(query, self.folding)

    def _read(self, query: str) -> dict:
        """Tokens, intent and safe form of a query, evaluated while planning: no job runs."""
        if self._columns is None:  # made once: the rules are a large expression
            c = F.col("query")
            self._columns = [self.tokens(c).alias("tokens"), rules.route(c, self.rules).alias("intent"), answering.sanitize(c).alias("safe")]
        return local(self.chunks.sparkSession, {"query": [query]}).select(*self._columns).first().asDict()

    def _encoded(self, query: str) -> np.ndarray:
        v = np.asarray((self.embed or dense.hashing_embedder())(["query: " + query]), float)[0]
        n = np.linalg.norm(v)
        return np.float32(v / n if n > 0 else v).astype(float)

    def _sides(self, query: str, tokens: list[str], pool: int) -> list[tuple[float, list]]:
        """(weight, units in order) of the sparse and the dense side, each one job, side by side."""
        spark = self.chunks.sparkSession

        def sparse():
            if self.index is not None:
                return [u for u, _ in search_index.best(self.index, tokens, pool)]
            q = spark.createDataFrame([(0, tokens)], "qid long, tokens array<string>")
            return [r["unit"] for r in bm25.search(self.chunks, q, pool).orderBy("rank").collect()]

        def near():
            vector = self._encoded(query)
            if isinstance(self.vectors, VectorIndex):
                return [u for u, _ in vector_index.nearest(self.vectors, vector, pool)]
            q = local(spark, {"qid": [0], "vector": [vector.tolist()]})
            return [r["unit"] for r in dense.search(self.vectors, q, pool).orderBy("rank").collect()]

        if self.vectors is None:
            return [(self.retrieval.w_sparse, sparse())]
        with ThreadPoolExecutor(2) as run:
            a, b = run.submit(sparse), run.submit(near)
            return [(self.retrieval.w_sparse, a.result()), (self.retrieval.w_dense, b.result())]

    def _hits(self, query: str, tokens: list[str], filters: dict, config: RetrievalConfig) -> list[dict]:
        """What ``retrieve`` gives for one query: the pools are fused here, at most two of them, and their units looked up in one job."""
        filters = {k: v for k, v in filters.items() if v is not None}
        if config.pad_zero_scores or (filters and config.filter_mode == "pre"):
            return self._planned(query, tokens, filters, config)
        fused: dict[int, float] = {}
        for weight, units in self._sides(query, tokens, config.pool * (config.pool_mult if filters else 1)):
            for rank, unit in enumerate(units, 1):
                fused[unit] = fused.get(unit, 0.0) + weight / (config.k_rrf + rank)
        if not fused:
            return []
        found = [r for r in self._rows(list(fused), config) if all(v in (r["teams"] or []) if c == "team" else r[c] == v for c, v in filters.items())]
        best: dict[int, dict] = {}
        for r in sorted((r | {"score": _rounded(fused[r["unit"]] * r["boost"], config.digits)} for r in found), key=lambda r: (-r["score"], r["unit"])):
            best.setdefault(r["doc"], r)
        return [r | {"rank": i} for i, r in enumerate(list(best.values())[: config.k_final], 1)]

    def _rows(self, units: list[int], config: RetrievalConfig) -> list[dict]:
        """The rows of these units with their recency; those not in memory are read by one job."""
        day = self.now or str(date.today())
        held = self._seen.found((day, u) for u in units)
        new = [u for u in units if (day, u) not in held]
        if new:
            if self._picked is None:
                head = lambda c: F.substring(c, 1, max(self.config.long_body, self.config.short_body)).alias(c)
                self._picked = ["unit", "doc", "chunk_id", "title", head("body_clean"), head("text"), "pub_date", "article_type", "league", "teams", "source_url"]
            if self._boost is None or self._boost[0] != (day, config):
                self._boost = (day, config), fusion.recency(F.col("pub_date"), F.lit(day).cast("date"), config).alias("boost")
            wanted = self.chunks.where(f"unit in ({', '.join(map(str, new))})")
            for r in wanted.select(*self._picked, self._boost[1]).collect():  # at most the pools
                held[day, r["unit"]] = r.asDict()
                self._seen.put((day, r["unit"]), held[day, r["unit"]], 2 * sum(len(x) for x in r if isinstance(x, str)) + 500)
        return [held[day, u] for u in units if (day, u) in held]

    def _day(self) -> Column:
        return F.lit(self.now).cast("date") if self.now else F.current_date()

    def _planned(self, query: str, tokens: list[str], filters: dict, config: RetrievalConfig) -> list[dict]:
        """The same by the batch plan, for settings that need statistics of the filtered units."""
        spark = self.chunks.sparkSession
        q = spark.createDataFrame([(0, tokens, self._encoded(query).tolist())], "qid long, tokens array<string>, vector array<double>")
        hits = retrieve(self.chunks, q, self._day(), self.vectors, filters, config=config, index=self.index)
        return [r.asDict() for r in hits.orderBy("rank").collect()]  # at most k_final

    def health(self, probe: str) -> dict:
        """The state of the engine by one real retrieval: ok with the number of chunks, or what failed."""
        try:
            found = len(self._hits(probe, self._read(probe)["tokens"], {}, replace(self.retrieval, k_final=1)))
            n = self.index.n_units if self.index else self.chunks.count()
        except Exception as e:  # a health check reports whatever goes wrong
            return {"status": "error", "reason": str(e).splitlines()[0] if str(e) else type(e).__name__}
        return {"status": "ok", "chunks": n} if found else {"status": "error", "reason": "no results"}

    def ask(self, query: str, article_type: str | None = None, league: str | None = None, team: str | None = None, request_id: str | None = None, caller: str | None = None) -> dict:
        """Answer, intent, sources, model, fallback, cache state, timings, number of chunks and
        the request's id (made where none is given).  A blank query gives no answer; a ``caller`` over the
        limiter's limit gets none either (``rate_limited``)."""
        request_id = request_id or uuid.uuid4().hex[:12]
        if self.limiter is not None and caller is not None and not self.limiter.allow(caller):
            return {"request_id": request_id} | NO_ANSWER | {"cache_reason": "rate_limited"}
        return {"request_id": request_id} | self._ask(query, article_type, league, team)

    def _ask(self, query: str, article_type: str | None, league: str | None, team: str | None) -> dict:
        if not query.strip():
            return dict(NO_ANSWER)
        low, high = self.config.query_chars
        if not low <= len(query) <= high:
            raise ValueError(f"a query has {low} to {high} characters")
        head = self._read(query)
        intent, safe = head["intent"], head["safe"]
        out = NO_ANSWER | {"answer": ar.OUT_OF_SCOPE_ANSWER, "intent": intent, "cache_reason": "out_of_scope"}
        if intent == "out_of_scope":
            return out
        filters = {"article_type": article_type or self.rules.filter_type.get(intent), "league": league, "team": team}
        t0 = time.monotonic()
        rows = self._hits(query, head["tokens"], filters, self.retrieval)
        out["retrieval_ms"] = int((time.monotonic() - t0) * 1000)
        if not rows:
            return out | {"answer": ar.REFUSAL_ANSWER, "cache_reason": "no_chunks"}
        context, sources = self._context(rows)
        out |= {"sources": sources[: self.config.max_sources], "n_chunks": len(rows)}
        return out | self._generated(intent, [r["chunk_id"] for r in rows], query, safe, context)

    def _context(self, rows) -> tuple[str, list[dict]]:
        parts, sources = [], []
        for r in rows:
            day = (r["pub_date"] or "")[:10]
            size = self.config.long_body if r["article_type"] == "lineup" else self.config.short_body
            head = f"[{r['rank']}] {r['title'] or ''}" + (f" ({day})" if day else "")
            parts.append(f"{head}\n{(r['body_clean'] or r['text'] or '')[:size]}")
            sources.append({"title": r["title"] or "", "url": r["source_url"] or "", "pub_date": day, "article_type": r["article_type"] or "", "league": r["league"] or "", "chunk_id": r["chunk_id"], "rrf_score": round(r["score"], 6)})
        return answering.CONTEXT_SEPARATOR.join(parts), sources

    def prompt(self, context: str, safe: str) -> str:
        rule = "─" * 40
        return f"{answering.PROMPT_HEAD}\n\n{context}\n\n{rule}\n\n{answering.PROMPT_NOTE}\n{answering.FENCES[0]}\n{safe}\n{answering.FENCES[1]}"

    def _generated(self, intent: str, ids: list[str], query: str, safe: str, context: str) -> dict:
        wanted = self.small if intent in self.rules.extractive else self.big
        lifetime = answering.TTL_SECONDS.get(intent, self.config.default_ttl)
        old = self.cache.get(cache_key(wanted, intent, ids, query, self.config), lifetime)
        if old is not None:
            return {"answer": old, "model": wanted, "cached": True, "cache_reason": "hit"}
        tokens = lambda s: max(1, len(s) // 3)
        system = self.system + self.prompts.get(intent, "")
        user = self.prompt(context, safe)
        if tokens(system) + tokens(user) + self.config.max_tokens > self.config.max_prompt_tokens:
            user = self.prompt(context[: len(context) // 2], safe)
        t0 = time.monotonic()
        model, answer, reason = wanted, "", "miss"
        for model in dict.fromkeys([wanted, self.small]):
            try:
                answer, reason = strip_placeholder(self.generate(model, system, user).strip()), "miss"
                if not answer:
                    reason = "skipped_error"
                break
            except RateLimited:
                reason = "skipped_rate_limit"
            except Exception:
                reason = "skipped_error"
                break
        out = {"llm_ms": int((time.monotonic() - t0) * 1000), "cache_reason": reason, "model_fallback": model != wanted}
        if reason != "miss":
            return out | {"answer": ar.ERROR_ANSWER, "model": None}
        self.cache.put(cache_key(model, intent, ids, query, self.config), answer, query=query, intent=intent, model=model, prompt_v=self.config.prompt_version)
        return out | {"answer": answer, "model": model}


def _rounded(x: float, digits: int) -> float:
    """As the column function rounds: halves away from zero, by the shortest decimal form."""
    return float(Decimal(repr(x)).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP))


def strip_placeholder(answer: str) -> str:
    """The driver-side twin of ``functions.answering.strip_placeholder``."""
    import re

    return re.sub(r"\s*\[\s*[Nn]\s*\]\s*$", "", answer).rstrip()


def source_cards(sources: list[dict]) -> str:
    """Sources as HTML: linked title (70 characters), day, type and league."""
    from html import escape

    cards = []
    for x in sources:
        facts = " · ".join(escape(v) for v in (x["pub_date"][:10], x["article_type"], x["league"]) if v)
        cards.append(f'<div class="source"><a href="{escape(x["url"])}">{escape(x["title"][:70])}</a><span>{facts}</span></div>')
    return "".join(cards)


LOG_FIELDS = ("request_id", "intent", "model", "model_fallback", "cached", "cache_reason", "retrieval_ms", "llm_ms", "n_chunks", "status", "error")


def log_line(level: str, logger: str, message: str, **extra) -> str:
    """One JSON log record; only the listed extra fields are written."""
    return json.dumps({"ts": time.time(), "level": level, "logger": logger, "msg": message} | {k: extra[k] for k in LOG_FIELDS if k in extra}, ensure_ascii=False)
