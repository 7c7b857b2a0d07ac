"""A language model in the answer path: prompts from evidence, one call for each distinct prompt, stored responses.

A client is made once for each task by a factory and called with a prompt's messages; a call that fails is tried again
after a pause that doubles, and what fails to the end is a row with the error. Responses are written before anything reads
them, to a table by the prompt's hash if there is one: a prompt that has a response is not asked again, so a lost job
only repeats the calls that it had not yet written.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from urllib import request

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulora.cut import cut
from tabulora.operators import answer
from tabulora.sources.tables import Table

#: Columns of the response table.
RESPONSES = "prompt_hash string, response string, error string"
ATTEMPTS, PAUSE = 3, 0.5

Client = Callable[[list[dict]], str]


def prompts(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """(query_id, prompt_hash, messages as JSON) of the queries that have evidence."""
    rows = queries.join(answer.context(hits), "query_id").where("context <> ''")
    text = F.to_json(answer.messages(F.col("query"), F.col("context")))
    return rows.select("query_id", F.sha2(text, 256).alias("prompt_hash"), text.alias("messages"))


def asked(rows: DataFrame, make: Callable[[], Client], attempts: int = ATTEMPTS, pause: float = PAUSE) -> DataFrame:
    """(prompt_hash, response, error) of prompts (prompt_hash, messages), each asked once."""

    def run(frames: Iterator):
        import pandas as pd

        client = None
        for pdf in frames:
            out = []
            for key, text in zip(pdf["prompt_hash"], pdf["messages"], strict=True):
                response = error = None
                for k in range(attempts):
                    try:
                        client = client or make()
                        response, error = client(json.loads(text)), None
                        break
                    except Exception as e:  # noqa: BLE001  whatever a client raises becomes the row's error
                        error = f"{type(e).__name__}: {e}"[:500]
                        if k + 1 < attempts:
                            time.sleep(pause * 2**k)
                out.append((key, response, error))
            yield pd.DataFrame(out, columns=["prompt_hash", "response", "error"])

    return rows.select("prompt_hash", "messages").dropDuplicates(["prompt_hash"]).mapInPandas(run, RESPONSES)


def generated(rows: DataFrame, make: Callable[[], Client], stored: Table | None = None, attempts: int = ATTEMPTS, pause: float = PAUSE) -> DataFrame:
    """Responses of prompts, from the table where it has them; new ones are added to it, errors are not."""
    if stored is None:
        return cut(asked(rows, make, attempts, pause))
    known = stored.read().select("prompt_hash").distinct()
    new = cut(asked(rows.join(known, "prompt_hash", "left_anti"), make, attempts, pause))
    stored.append(new.where("error is null and response is not null"))
    # two writers may have asked the same
    have = stored.read().groupBy("prompt_hash").agg(F.min("response").alias("response"), F.lit(None).cast("string").alias("error"))
    return have.join(rows.select("prompt_hash").distinct(), "prompt_hash", "left_semi").unionByName(new.where("error is not null"))


def answers(queries: DataFrame, hits: DataFrame, make: Callable[[], Client], top_k: int = 5, stored: Table | None = None, **options) -> DataFrame:
    """The columns of answer.answer and `error`: a model's answer where the evidence is enough, the summary of evidence
    where the model fails or says nothing, a refusal else. Queries that the guard stops are not asked."""
    plain = cut(answer.answer(queries, hits, top_k))
    found = answer.summaries(answer.evidence(hits, queries), queries).withColumnRenamed("answer", "_summary")
    cited = answer.citations(hits, top_k).withColumnRenamed("citations", "_cited")
    rows = cut(prompts(queries.join(plain.where("guard_passed").select("query_id"), "query_id", "left_semi"), hits))
    said = generated(rows, make, stored, **options)
    made = rows.join(said, "prompt_hash", "left").select("query_id", F.nullif(F.trim("response"), F.lit("")).alias("_said"), "error")
    out = plain.join(made, "query_id", "left").join(found, "query_id", "left").join(cited, "query_id", "left")
    ok = F.col("guard_passed")
    return out.select(
        "query_id", "query", F.when(ok, F.coalesce("_said", "_summary", F.lit("没有可用证据。"))).otherwise(F.col("answer")).alias("answer"), F.when(ok, F.col("_cited")).alias("citations"), "guard_passed",
        F.when(~ok, F.col("refusal_reason")).alias("refusal_reason"), F.when(~ok, "refusal").when(F.col("_said").isNotNull(), "llm").otherwise("fallback_summary").alias("answer_mode"), "error",
    )


def http_client(base_url: str, key: str, model: str, timeout: float = 60.0, max_tokens: int = 1024, temperature: float = 0.1) -> Callable[[], Client]:
    """A factory of clients for servers with the common chat-completions interface."""

    def make() -> Client:
        def call(messages: list[dict]) -> str:
            body = json.dumps({"model": model, "messages": messages, "temperature": temperature, "max_tokens": max_tokens}).encode()
            req = request.Request(f"{base_url.rstrip('/')}/chat/completions", body, {"Content-Type": "application/json", "Authorization": f"Bearer {key}"})
            with request.urlopen(req, timeout=timeout) as r:
                return content_of(json.loads(r.read()))

        return call

    return make


def content_of(reply: dict) -> str:
    """The text of a reply: plain, or the parts of kind text."""
    choices = reply.get("choices") or []
    if not choices:
        raise ValueError("the model returned no choices")
    content = (choices[0].get("message") or {}).get("content")
    if isinstance(content, list):
        return "\n".join(p["text"] for p in content if isinstance(p, dict) and p.get("type") == "text" and p.get("text"))
    if not isinstance(content, str):
        raise ValueError("the model returned content of an unknown form")
    return content
