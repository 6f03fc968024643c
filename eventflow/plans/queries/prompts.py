"""Conversation history, generation requests and responses."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventflow.functions import json_text, templates
from eventflow.operators import prompts as p
from eventflow.operators.ordered import most_recent
from eventflow.operators.prompts import ModelConfig
from eventflow.plans.registry import Tables, query
from eventflow.sources import context


def _chunk():
    """Blocks of turn numbers: never decreasing along a conversation."""
    return F.floor(F.col("turn") / 1024)


def remembered(t: Tables, size: int):
    return p.history(t.conversations, ["conv_id"], [F.col("turn")], _chunk(), size=size)


_LINE = "CASE role WHEN 'user' THEN 'User: ' WHEN 'assistant' THEN 'Assistant: ' WHEN 'system' THEN 'System: ' ELSE '' END || text"


def _context_sql(size: int) -> str:
    return f"""
    SELECT conv_id, turn, role, text, string_agg({_LINE}, chr(10) || chr(10)) OVER (
        PARTITION BY conv_id ORDER BY turn ROWS BETWEEN {size - 1} PRECEDING AND CURRENT ROW) AS context FROM conversations
    """


@query("""
SELECT conv_id, turn, count(*) OVER w AS kept, string_agg(role, ',') OVER w AS roles,
       CAST(sum(length(text)) OVER w AS BIGINT) AS chars
FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)
""")
def history_last10(t: Tables):
    lengths = F.transform("history", lambda h: F.length(h["content"]).cast("bigint"))
    return remembered(t, p.HISTORY).select(
        "conv_id",
        "turn",
        F.size("history").cast("bigint").alias("kept"),
        F.array_join(F.transform("history", lambda h: h["role"]), ",").alias("roles"),
        F.aggregate(lengths, F.lit(0).cast("bigint"), lambda a, b: a + b).alias("chars"),
    )


@query(f"SELECT conv_id, turn, context FROM ({_context_sql(3)})")
def history_context(t: Tables):
    return remembered(t, 3).select("conv_id", "turn", p.context_of(F.col("history")).alias("context"))


@query(f"""
SELECT conv_id, turn, context || chr(10) || chr(10) || 'User: ' || text AS prompt FROM ({_context_sql(10)}) WHERE role = 'user'
""")
def full_prompt(t: Tables):
    asked = remembered(t, p.HISTORY).where("role = 'user'")
    return asked.select("conv_id", "turn", p.full_prompt(F.col("history"), F.col("text")).alias("prompt"))


@query("""
SELECT conv_id, turn, role FROM (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) WHERE n <= 3
""")
def recent_n(t: Tables):
    turns = t.conversations.select("conv_id", "turn", "role")
    return most_recent(turns, ["conv_id"], [F.desc("turn")], 3)


def requests(t: Tables):
    """Messages that ask for a text: system turns lack the prompt, user turns bring options."""
    options = F.struct(F.lit(0.1).alias("temperature"), (F.col("turn") + 100).alias("max_tokens"))
    body = F.struct(
        F.when(F.col("role") != "system", F.col("text")).alias("prompt"),
        F.when(F.col("role") == "user", options).alias("options"),
    )
    return t.conversations.select("conv_id", "turn", "role", "text", F.to_json(body).alias("payload"))


REQUEST = "prompt string, options struct<model string, temperature double, max_tokens bigint, top_p double, frequency_penalty double, presence_penalty double>"


def decoded(t: Tables):
    return json_text.decode(requests(t), T.StructType.fromDDL(REQUEST))


@query("""
SELECT conv_id, turn, CASE WHEN role <> 'system' THEN text END AS prompt, role = 'user' AS has_options,
       CASE WHEN role = 'system' THEN 'Missing or invalid ''prompt'' field in message' END AS error
FROM conversations
""")
def llm_input(t: Tables):
    missing = F.col("body.prompt").isNull()
    return decoded(t).select(
        "conv_id",
        "turn",
        F.col("body.prompt").alias("prompt"),
        F.col("body.options").isNotNull().alias("has_options"),
        F.when(missing, p.MISSING_PROMPT).alias("error"),
    )


@query("""
SELECT conv_id, turn, 'gpt-4' AS model, CAST(CASE WHEN role = 'user' THEN 0.1 ELSE 0.7 END AS DOUBLE) AS temperature,
       CASE WHEN role = 'user' THEN turn + 100 ELSE 2048 END AS max_tokens, CAST(1.0 AS DOUBLE) AS top_p
FROM conversations
""")
def option_merge(t: Tables):
    merged = p.merged_options(F.col("body.options"), ModelConfig())
    return decoded(t).select("conv_id", "turn", merged.alias("o")).select(
        "conv_id", "turn", "o.model", "o.temperature", "o.max_tokens", "o.top_p"
    )


_PROVIDER_SQL = "CASE role WHEN 'user' THEN 'OpenAI' WHEN 'assistant' THEN 'anthropic' ELSE CASE WHEN conv_id < 100 THEN 'local' ELSE 'other' END END"


def provider():
    return (
        F.when(F.col("role") == "user", "OpenAI")
        .when(F.col("role") == "assistant", "anthropic")
        .when(F.col("conv_id") < 100, "local")
        .otherwise("other")
    )


@query(f"""
WITH r AS (SELECT *, {_PROVIDER_SQL} AS provider FROM conversations)
SELECT conv_id, turn, provider, CASE WHEN provider IN ('OpenAI', 'anthropic') THEN 'gpt-4' END AS model,
       CASE WHEN provider <> 'other' THEN text END AS prompt,
       CASE WHEN provider = 'other' THEN -1 WHEN role = 'user' THEN turn + 100 ELSE 2048 END AS max_tokens,
       CASE WHEN provider = 'other' THEN 'Unsupported LLM provider: other' END AS error
FROM r
""")
def llm_request(t: Tables):
    rows = decoded(t).withColumns({"provider": provider(), "o": p.merged_options(F.col("body.options"), ModelConfig())})
    built = rows.withColumn("request", p.request_body(F.col("provider"), F.col("text"), F.col("o")))
    sent = F.coalesce(F.get_json_object("request", "$.messages[0].content"), F.get_json_object("request", "$.prompt"))
    tokens = F.get_json_object("request", "$.max_tokens").cast("bigint")
    return built.select(
        "conv_id",
        "turn",
        "provider",
        F.get_json_object("request", "$.model").alias("model"),
        sent.alias("prompt"),
        F.coalesce(tokens, F.lit(-1)).alias("max_tokens"),
        p.unsupported(F.col("provider")).alias("error"),
    )


def responses(t: Tables):
    """Response bodies in the shape of each provider, built from the turns."""
    size, kind = F.length("text").cast("bigint"), F.lower(F.col("provider"))
    usage = F.struct(F.lit(10).alias("prompt_tokens"), size.alias("completion_tokens"), (size + 10).alias("total_tokens"))
    chat = F.struct(F.array(F.struct(F.struct(F.col("text").alias("content")).alias("message"))).alias("choices"), usage.alias("usage"))
    blocks = F.struct(
        F.array(F.struct("text")).alias("content"),
        F.struct(F.lit(10).alias("input_tokens"), size.alias("output_tokens")).alias("usage"),
    )
    plain = F.struct(F.array(F.struct("text")).alias("choices"), usage.alias("usage"))
    body = (
        F.when(kind == "openai", F.to_json(chat))
        .when(kind == "anthropic", F.to_json(blocks))
        .when(kind == "local", F.to_json(plain))
        .otherwise("{}")
    )
    return t.conversations.withColumn("provider", provider()).withColumn("body", body)


@query(f"""
WITH r AS (SELECT *, {_PROVIDER_SQL} AS provider FROM conversations)
SELECT conv_id, turn, CASE WHEN provider <> 'other' THEN text END AS text,
       CAST(CASE WHEN provider = 'other' THEN -1 ELSE 10 END AS BIGINT) AS prompt_tokens,
       CASE WHEN provider = 'other' THEN -1 ELSE length(text) END AS completion_tokens,
       CASE WHEN provider IN ('other', 'anthropic') THEN -1 ELSE length(text) + 10 END AS total_tokens,
       CASE WHEN provider = 'other' THEN 'Invalid response format from other' END AS error
FROM r
""")
def llm_response(t: Tables):
    parsed = p.parse_response(F.col("provider"), F.lit("gpt-4"), F.col("body"))
    out = responses(t).select("conv_id", "turn", parsed.alias("r"))
    tokens = ["prompt_tokens", "completion_tokens", "total_tokens"]
    return out.select("conv_id", "turn", "r.text", *[F.coalesce(f"r.{n}", F.lit(-1)).alias(n) for n in tokens], "r.error")


def load_echo():
    """A deterministic client: length and digest of the whole prompt."""

    def generate(prompts: list[str]) -> list[str]:
        return [f"{len(x)}:{hashlib.md5(x.encode()).hexdigest()}" for x in prompts]

    return generate


def load_picky():
    """The same, but it fails on prompts of more than 150 characters."""
    plain = load_echo()

    def generate(prompts: list[str]) -> list[str]:
        if any(len(x) > 150 for x in prompts):
            raise RuntimeError("prompt too long")
        return plain(prompts)

    return generate


@query("SELECT doc_id, length(text) || ':' || md5(text) AS response FROM documents")
def llm_generate(t: Tables):
    return p.generate(t.documents.select("doc_id", "text"), "text", load_echo).select("doc_id", "response")


@query("""
SELECT conv_id, turn, CASE WHEN length(text) <= 150 THEN 'results' ELSE 'errors' END AS topic,
       CASE WHEN length(text) <= 150 THEN length(text) || ':' || md5(text) END AS response,
       CASE WHEN length(text) > 150 THEN 'prompt too long' END AS error,
       CASE WHEN length(text) > 150 THEN text END AS input
FROM conversations
""")
def llm_error_split(t: Tables):
    done = p.generate(t.conversations.select("conv_id", "turn", "text"), "text", load_picky, max_retries=1)
    record = p.output_record(F.col("response"), F.lit("echo"), F.col("error"), F.col("text"), F.lit("2024-01-01T00:00:00Z"))
    topic = F.when(F.col("error").isNull(), "results").otherwise("errors")
    sent = done.select("conv_id", "turn", topic.alias("topic"), record.alias("payload"))
    fields = {"response": "$.response", "error": "$.error", "input": "$.input"}
    return sent.select("conv_id", "turn", "topic", *[F.get_json_object("payload", at).alias(n) for n, at in fields.items()])


def load_slow():
    """A client that never answers in time where the text's digest begins with 00."""
    import hashlib
    import time

    def generate(prompts):
        (text,) = prompts
        digest = hashlib.md5(text.encode()).hexdigest()
        if digest.startswith("00"):
            time.sleep(20)
        return [digest]

    return generate


@query("""
SELECT conv_id, turn, CASE WHEN md5(text) NOT LIKE '00%' THEN md5(text) END AS response,
       CASE WHEN md5(text) LIKE '00%' THEN 'Timed out after 3 s' END AS error
FROM conversations
""")
def llm_time_limit(t: Tables):
    done = p.generate(t.conversations.select("conv_id", "turn", "text"), "text", load_slow, timeout_secs=3)
    return done.select("conv_id", "turn", "response", "error")


@query("""
WITH c AS (SELECT string_agg(n_name || ' in ' || r_name, chr(10) ORDER BY n_nationkey) AS context
           FROM nation JOIN region ON r_regionkey = n_regionkey)
SELECT conv_id, turn, 'Known places:' || chr(10) || context || chr(10) || 'Q: ' || text AS prompt FROM conversations, c
""")
def context_prompt(t: Tables):
    places = t.nation.join(t.region, F.col("r_regionkey") == F.col("n_regionkey"))
    line = F.concat("n_name", F.lit(" in "), "r_name")
    turns = t.conversations.select("conv_id", "turn", "text").withColumn(
        "context", F.struct(context.context_text(places, line, "n_nationkey").alias("places"))
    )
    prompt = templates.render("Known places:\n{{context.places}}\nQ: {{text}}", turns.schema)
    return turns.select("conv_id", "turn", prompt.alias("prompt"))


@query("""
SELECT doc_id, source AS provider, CASE WHEN lang = 'en' THEN lang || '/' || n_chars WHEN lang = 'fr' THEN lang END AS model FROM documents
""")
def engine_split(t: Tables):
    engine = (
        F.when(F.col("lang") == "en", F.concat_ws("/", "source", "lang", F.col("n_chars").cast("string")))
        .when(F.col("lang") == "fr", F.concat_ws("/", "source", "lang"))
        .otherwise(F.col("source"))
    )
    return t.documents.select("doc_id", p.split_engine(engine).alias("e")).select("doc_id", "e.provider", "e.model")
