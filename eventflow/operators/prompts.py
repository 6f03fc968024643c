"""Text generation around a user-supplied function: history, requests, responses."""

from __future__ import annotations

import itertools
import queue
import threading
import time
from collections import deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .ordered import trailing

# History length, role labels, separator, supported providers, error texts.
HISTORY = 10
ROLE_LABELS = {"user": "User: ", "assistant": "Assistant: ", "system": "System: "}
BETWEEN = "\n\n"
PROVIDERS = ("openai", "anthropic", "local")
MISSING_PROMPT = "Missing or invalid 'prompt' field in message"
UNSUPPORTED = "Unsupported LLM provider: "
BAD_RESPONSE = "Invalid response format from "

TIMED_OUT = "Timed out after "
TOO_MANY_LATE = "Too many late calls still running"


@dataclass(frozen=True)
class ModelConfig:
    """Defaults of a generation request."""

    provider: str = "openai"
    model: str = "gpt-4"
    temperature: float = 0.7
    max_tokens: int = 2048
    top_p: float = 1.0
    frequency_penalty: float = 0.0
    presence_penalty: float = 0.0
    timeout_secs: int = 30
    max_retries: int = 3


OPTIONS_TYPE = T.StructType(
    [
        T.StructField("model", T.StringType()),
        T.StructField("temperature", T.DoubleType()),
        T.StructField("max_tokens", T.LongType()),
        T.StructField("top_p", T.DoubleType()),
        T.StructField("frequency_penalty", T.DoubleType()),
        T.StructField("presence_penalty", T.DoubleType()),
    ]
)


def history(
    df: DataFrame, keys: list[str], order: list[Column], chunk: Column, role: str = "role", content: str = "text", size: int = HISTORY
) -> DataFrame:
    """Add ``history``: the last ``size`` ``{role, content}`` turns, this one included."""
    turn = F.struct(F.col(role).alias("role"), F.col(content).alias("content"))
    return trailing(df, keys, order, chunk, size, turn, "history")


def context_of(turns: Column) -> Column:
    """History as text; turns of other roles appear without a label."""

    def line(turn: Column) -> Column:
        label = F.lit("")
        for name, text in ROLE_LABELS.items():
            label = F.when(turn["role"] == name, text).otherwise(label)
        return F.concat(label, F.coalesce(turn["content"], F.lit("")))

    return F.array_join(F.transform(turns, line), BETWEEN)


def full_prompt(turns: Column, prompt: Column, dedup_prompt: bool = False) -> Column:
    """Context, then the prompt. The prompt is already the last turn of the
    history and so appears twice, unless ``dedup_prompt``."""
    known = F.slice(turns, 1, F.greatest(F.size(turns) - 1, F.lit(0))) if dedup_prompt else turns
    context = context_of(known)
    return F.when(context == "", prompt).otherwise(
        F.concat(context, F.lit(BETWEEN), F.lit(ROLE_LABELS["user"]), prompt)
    )


def merged_options(options: Column, config: ModelConfig) -> Column:
    """Message options over configured defaults, field by field."""
    return F.struct(
        *[F.coalesce(options[f.name], F.lit(getattr(config, f.name)).cast(f.dataType)).alias(f.name) for f in OPTIONS_TYPE]
    )


def merged_map(defaults: Column, options: Column) -> Column:
    """The same for free string maps; the later entry wins."""
    known = F.map_filter(defaults, lambda k, _: ~F.map_contains_key(options, k))
    return F.map_concat(known, options)


def split_engine(engine: Column) -> Column:
    """``"provider/model"`` to ``{provider, model}``; the model may contain slashes."""
    parts = F.split(engine, "/", 2)
    return F.struct(parts[0].alias("provider"), F.try_element_at(parts, F.lit(2)).alias("model"))


def request_body(provider: Column, prompt: Column, options: Column, extra: Column | None = None) -> Column:
    """JSON request for the provider; NULL for one that is not supported.

    ``extra`` is a map from further option names to their values in JSON. They are
    sent to every provider as they are, except names the request holds already.
    """
    name = F.lower(provider)
    messages = F.array(F.struct(F.lit("user").alias("role"), prompt.alias("content"))).alias("messages")

    def body(*parts) -> Column:
        return F.to_json(F.struct(*[options[p].alias(p) if isinstance(p, str) else p for p in parts]))

    tuning = ("temperature", "max_tokens", "top_p", "frequency_penalty", "presence_penalty")
    request = (
        F.when(name == "openai", body("model", messages, *tuning))
        .when(name == "anthropic", body("model", "max_tokens", "temperature", "top_p", messages))
        .when(name == "local", body(prompt.alias("prompt"), *tuning))
    )
    if extra is None:
        return request
    free = F.map_filter(extra, lambda k, v: v.isNotNull() & ~F.array_contains(F.json_object_keys(request), k))
    quoted = lambda k: F.regexp_replace(F.to_json(F.array(k)), r"^\[|\]$", "")
    pairs = F.transform(F.array_sort(F.map_entries(free)), lambda e: F.concat(quoted(e["key"]), F.lit(":"), e["value"]))
    open_end = F.substring(request, F.lit(1), F.length(request) - 1)
    more = F.concat(open_end, F.lit(","), F.array_join(pairs, ","), F.lit("}"))
    return F.when(F.size(free) > 0, more).otherwise(request)


def unsupported(provider: Column) -> Column:
    """Error text for an unknown provider, else NULL."""
    known = F.coalesce(F.lower(provider).isin(*PROVIDERS), F.lit(False))
    shown = F.coalesce(provider, F.lit("none"))
    return F.when(~known, F.concat(F.lit(UNSUPPORTED), shown))


def parse_response(provider: Column, model: Column, body: Column) -> Column:
    """``{text, model, prompt_tokens, completion_tokens, total_tokens, error}``."""
    name = F.lower(provider)

    def at(path: str) -> Column:
        return F.get_json_object(body, path)

    def number(path: str) -> Column:
        return at(path).try_cast("bigint")

    theirs = name == "anthropic"
    text = (
        F.when(name == "openai", at("$.choices[0].message.content"))
        .when(theirs, at("$.content[0].text"))
        .when(name == "local", at("$.choices[0].text"))
    )
    return F.struct(
        text.alias("text"),
        model.alias("model"),
        F.when(theirs, number("$.usage.input_tokens")).otherwise(number("$.usage.prompt_tokens")).alias("prompt_tokens"),
        F.when(theirs, number("$.usage.output_tokens")).otherwise(number("$.usage.completion_tokens")).alias("completion_tokens"),
        F.when(~theirs, number("$.usage.total_tokens")).alias("total_tokens"),
        F.when(text.isNull(), F.concat(F.lit(BAD_RESPONSE), F.coalesce(name, F.lit("none")))).alias("error"),
    )


def output_record(response: Column, model: Column, error: Column, original: Column, at: Column) -> Column:
    """``{response, model}`` as JSON, or ``{error, input, timestamp}`` where it failed."""
    done = F.to_json(F.struct(response.alias("response"), model.alias("model")))
    failed = F.to_json(F.struct(error.alias("error"), original.alias("input"), at.alias("timestamp")))
    return F.when(error.isNull(), done).otherwise(failed)


Generate = Callable[[list[str]], list[str]]


def _generate(generate: Generate, prompts: list[str], retries: int) -> tuple[list, list]:
    for _ in range(retries + 1):
        try:
            answers = list(generate(prompts))
            if len(answers) != len(prompts):
                raise ValueError(f"{len(prompts)} prompts, but {len(answers)} answers")
            return answers, [None] * len(prompts)
        except Exception as problem:
            last = str(problem)
    if len(prompts) == 1:
        return [None], [last]
    answers, errors = [], []
    for prompt in prompts:
        one, error = _generate(generate, [prompt], retries)
        answers += one
        errors += error
    return answers, errors


class TimedCalls:
    """Calls of a client, one per prompt and a few at a time, each with a time limit; results keep the order of the prompts.

    A call that is still running at its limit is left to itself and no longer waited for. Of such
    calls there are at most ``most_late``; while there are as many, further prompts fail at once.
    """

    def __init__(self, client: Generate, seconds: float, at_once: int = 8, most_late: int = 64):
        self.client, self.seconds, self.at_once, self.most_late = client, seconds, at_once, most_late
        self.ended: queue.SimpleQueue = queue.SimpleQueue()
        self.late: set[int] = set()
        self.numbers = itertools.count()

    def _call(self, number: int, prompt: str) -> None:
        try:
            (answer,) = self.client([prompt])
            self.ended.put((number, answer, None))
        except Exception as problem:
            self.ended.put((number, None, str(problem)))

    def ask(self, prompts: list[str], retries: int = 0) -> tuple[list, list]:
        answers, errors = [None] * len(prompts), [None] * len(prompts)
        waiting = deque((i, retries) for i in range(len(prompts)))
        running: dict[int, tuple[int, int, float]] = {}

        def failed(i: int, tries: int, error: str) -> None:
            if tries:
                waiting.append((i, tries - 1))
            else:
                errors[i] = error

        while waiting or running:
            while waiting and len(running) < self.at_once and len(self.late) < self.most_late:
                i, tries = waiting.popleft()
                number = next(self.numbers)
                running[number] = (i, tries, time.monotonic() + self.seconds)
                threading.Thread(target=self._call, args=(number, prompts[i]), daemon=True).start()
            if not running:
                while not self.ended.empty():
                    self.late.discard(self.ended.get()[0])
                if len(self.late) < self.most_late:
                    continue
                for i, _ in waiting:
                    errors[i] = TOO_MANY_LATE
                break
            try:
                pause = min(due for _, _, due in running.values()) - time.monotonic()
                number, answer, error = self.ended.get(timeout=max(pause, 0))
            except queue.Empty:
                now = time.monotonic()
                for number in [n for n, (_, _, due) in running.items() if due <= now]:
                    i, tries, _ = running.pop(number)
                    self.late.add(number)
                    failed(i, tries, f"{TIMED_OUT}{self.seconds:g} s")
                continue
            if number in running:
                i, tries, _ = running.pop(number)
                if error is None:
                    answers[i] = answer
                else:
                    failed(i, tries, error)
            self.late.discard(number)
        return answers, errors


def generate(
    df: DataFrame, prompt: str, load: Callable[[], Generate], batch_size: int = 32, max_retries: int = 0,
    timeout_secs: float | None = None, at_once: int = 8,
) -> DataFrame:
    """Add ``response`` and ``error``. ``load`` builds the client once per task.

    With ``timeout_secs`` each prompt is a call of its own, ``at_once`` of them together (the client
    must bear that), and a call that takes longer is an error of its row; a retry has a new limit.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = load()
        timed = None if timeout_secs is None else TimedCalls(client, timeout_secs, at_once)
        for pdf in batches:
            answers, errors = [], []
            texts = [None if pd.isna(x) else x for x in pdf[prompt]]
            step = batch_size if timed is None else max(len(texts), 1)
            for start in range(0, len(texts), step):
                part = texts[start : start + step]
                asked = [p for p in part if p is not None]
                if timed is None:
                    got, bad = _generate(client, asked, max_retries) if asked else ([], [])
                else:
                    got, bad = timed.ask(asked, max_retries)
                replies = iter(zip(got, bad))
                for p in part:
                    answer, error = next(replies) if p is not None else (None, MISSING_PROMPT)
                    answers.append(answer)
                    errors.append(error)
            yield pdf.assign(response=answers, error=errors)

    extra = [T.StructField("response", T.StringType()), T.StructField("error", T.StringType())]
    return df.mapInPandas(run, T.StructType([*df.schema.fields, *extra]))
