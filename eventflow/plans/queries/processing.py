"""Validation, cleaning, features and imputation."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventflow.operators import impute, normalize, validate
from eventflow.operators.validate import FieldRule, Rules
from eventflow.plans.registry import Tables, query

from .common import PARTIAL_SQL, partial_events


def _checked(df, key: str, rules: Rules):
    """The key, the error messages as one text, and the verdict."""
    done = validate.validate(df, rules)
    return done.select(key, validate.messages().alias("problems"), validate.is_valid().alias("ok"))


@query(f"""
WITH e AS ({PARTIAL_SQL})
SELECT event_id, concat_ws('; ', CASE WHEN value IS NULL THEN 'Missing required field: value' END,
                                 'Missing required field: card') AS problems, false AS ok
FROM e
""")
def validate_required(t: Tables):
    rules = Rules({"value": FieldRule(required=True), "card": FieldRule(required=True), "note": FieldRule()})
    return _checked(partial_events(t.events), "event_id", rules)


@query("""
WITH d AS (SELECT doc_id, CASE WHEN lang = 'en' THEN CAST(n_chars AS VARCHAR) ELSE source END AS size_text FROM documents)
SELECT doc_id, CASE WHEN try_cast(size_text AS DOUBLE) IS NULL
                    THEN 'Invalid type for field ''size_text'': expected number, got string' ELSE '' END AS problems,
       try_cast(size_text AS DOUBLE) IS NOT NULL AS ok
FROM d
""")
def validate_type(t: Tables):
    text = F.when(F.col("lang") == "en", F.col("n_chars").cast("string")).otherwise(F.col("source"))
    docs = t.documents.select("doc_id", text.alias("size_text"))
    return _checked(docs, "doc_id", Rules({"size_text": FieldRule(type="number")}))


@query("""
SELECT doc_id, concat_ws('; ',
         CASE WHEN length(text) < 300 THEN 'Field validation failed for ''text'': shorter than 300' END,
         CASE WHEN length(text) > 1500 THEN 'Field validation failed for ''text'': longer than 1500' END,
         CASE WHEN len(words) > 200 THEN 'Field validation failed for ''words'': longer than 200' END) AS problems,
       length(text) BETWEEN 300 AND 1500 AND len(words) <= 200 AS ok
FROM (SELECT doc_id, text, string_split(text, ' ') AS words FROM documents)
""")
def validate_length(t: Tables):
    docs = t.documents.select("doc_id", "text", F.split("text", " ").alias("words"))
    rules = {"text": FieldRule(min_length=300, max_length=1500), "words": FieldRule(max_length=200)}
    return _checked(docs, "doc_id", Rules(rules))


@query("""
SELECT page_id, CASE WHEN regexp_matches(url, '^https://[a-z.]+/') THEN ''
                     ELSE 'Field validation failed for ''url'': does not match pattern' END AS problems,
       regexp_matches(url, '^https://[a-z.]+/') AS ok
FROM pages
""")
def validate_pattern(t: Tables):
    return _checked(t.pages.select("page_id", "url"), "page_id", Rules({"url": FieldRule(pattern="^https://[a-z.]+/")}))


@query(f"""
WITH e AS ({PARTIAL_SQL})
SELECT event_id, CASE WHEN kind IN ('signup', 'click') THEN 'Field validation failed for ''kind'': value not allowed' ELSE '' END AS problems,
       coalesce(kind NOT IN ('signup', 'click'), true) AS ok
FROM e
""")
def validate_enum(t: Tables):
    rules = Rules({"kind": FieldRule(allowed_values=("view", "purchase"))})
    return _checked(partial_events(t.events), "event_id", rules)


@query(f"""
WITH e AS ({PARTIAL_SQL})
SELECT event_id, CASE WHEN value IS NOT NULL AND NOT (value < 100 OR event_type = 'purchase')
                      THEN 'Field validation failed for ''value'': custom validator failed' ELSE '' END AS problems,
       coalesce(value < 100 OR event_type = 'purchase', true) AS ok
FROM e
""")
def validate_custom(t: Tables):
    rules = Rules({"value": FieldRule(custom_validator="value < 100 OR event_type = 'purchase'")})
    return _checked(partial_events(t.events), "event_id", rules)


@query("""
SELECT o_orderkey, (o_totalprice > 50000 AND NOT o_orderstatus = 'F') AS ok,
       concat_ws('; ', CASE WHEN NOT (o_totalprice > 50000 AND NOT o_orderstatus = 'F') THEN 'Validation error: all rule not met' END) AS problems
FROM orders
""")
def validate_global(t: Tables):
    rule = {"all": [{"custom": "o_totalprice > 50000"}, {"not": {"any": [{"custom": "o_orderstatus = 'F'"}]}}]}
    return _checked(t.orders, "o_orderkey", Rules(row=(rule,)))


_EVENT_RULES = Rules(
    {
        "value": FieldRule(required=True, type="number"),
        "event_type": FieldRule(required=True, type="string", allowed_values=("view", "click", "purchase", "signup")),
        "props": FieldRule(pattern='"k"', max_length=9),
    },
    row=({"custom": "event_type <> 'purchase' OR value >= 5"},),
)
_EVENT_ERRORS_SQL = """
    concat_ws('; ', CASE WHEN value IS NULL THEN 'Missing required field: value' END,
      CASE WHEN event_type NOT IN ('view', 'click', 'purchase', 'signup')
           THEN 'Field validation failed for ''event_type'': value not allowed' END,
      CASE WHEN length(props) > 9 THEN 'Field validation failed for ''props'': longer than 9' END,
      CASE WHEN NOT regexp_matches(props, '"k"') THEN 'Field validation failed for ''props'': does not match pattern' END,
      CASE WHEN NOT coalesce(event_type <> 'purchase' OR value >= 5, false)
           THEN 'Validation error: event_type <> ''purchase'' OR value >= 5' END)
"""


@query(f"""
WITH e AS ({PARTIAL_SQL}), c AS (SELECT event_id, {_EVENT_ERRORS_SQL} AS problems FROM e)
SELECT event_id, problems, problems = '' AS ok FROM c
""")
def validation_errors(t: Tables):
    return _checked(partial_events(t.events), "event_id", _EVENT_RULES)


@query(f"""
WITH e AS ({PARTIAL_SQL}), c AS (SELECT event_id, props, {_EVENT_ERRORS_SQL} AS problems FROM e)
SELECT event_id, CASE WHEN problems = '' THEN 'validated' ELSE 'errors' END AS topic,
       problems AS error, props AS original
FROM c
""")
def error_route(t: Tables):
    done = validate.validate(partial_events(t.events), _EVENT_RULES)
    routed = validate.route_errors(done.withColumn("original", F.col("props")), "validated", "errors", "props")
    failed = F.col("topic") == "errors"
    return routed.select(
        "event_id",
        "topic",
        F.when(failed, F.get_json_object("payload", "$.error")).otherwise("").alias("error"),
        F.when(failed, F.get_json_object("payload", "$.original_message")).otherwise(F.col("payload")).alias("original"),
    )


@query(f"""
WITH e AS ({PARTIAL_SQL}), c AS (SELECT event_id, {_EVENT_ERRORS_SQL} AS problems FROM e)
SELECT event_id, CASE WHEN problems = '' THEN 'processed' ELSE 'error' END AS status,
       CASE WHEN problems = '' THEN 'event' END AS schema, CASE WHEN problems = '' THEN 'event_rules' END AS rules,
       CASE WHEN problems <> '' THEN problems END AS error
FROM c
""")
def ack_status(t: Tables):
    done = validate.validate(partial_events(t.events), _EVENT_RULES)
    return done.select("event_id", validate.acknowledgement("event", "event_rules").alias("a")).select("event_id", "a.*")


@query("""
SELECT event_id, CASE event_type WHEN 'click' THEN 'Schema validation failed: unknown field campaign'
                                 WHEN 'error' THEN 'Schema validation failed: invalid JSON' ELSE '' END AS problems,
       event_type NOT IN ('click', 'error') AS ok
FROM events
""")
def strict_schema(t: Tables):
    extra = F.when(F.col("event_type") == "click", F.lit("c1")).alias("campaign")
    whole = F.to_json(F.struct("user_id", "value", extra))
    # Payloads of errors are cut off.
    sent = t.events.select("event_id", F.when(F.col("event_type") == "error", F.lit("{")).otherwise(whole).alias("payload"))
    checked = sent.withColumn("errors", validate.strict_schema_errors(F.col("payload"), ["user_id", "value"]))
    return checked.select("event_id", validate.messages().alias("problems"), validate.is_valid().alias("ok"))


@query("""
WITH s AS (SELECT d.doc_id, l.quality, CASE WHEN d.lang = 'de' THEN 'n/a' ELSE CAST(d.n_chars AS VARCHAR) END AS score
           FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id),
     c AS (SELECT doc_id, concat_ws('; ', CASE WHEN quality IS NULL THEN 'Missing required field: quality' END,
                  CASE WHEN score = 'n/a' THEN 'Invalid type for field ''score'': expected number, got string' END) AS problems FROM s)
SELECT doc_id, CASE WHEN problems = '' THEN 'scores' ELSE 'scores.errors' END AS topic, problems FROM c
""")
def output_schema_check(t: Tables):
    score = F.when(F.col("lang") == "de", "n/a").otherwise(F.col("n_chars").cast("string"))
    docs = t.documents.select("doc_id", "lang", "n_chars").join(t.labels.select("doc_id", "quality"), on="doc_id", how="left")
    results = docs.select("doc_id", "quality", score.alias("score"))
    declared = T.StructType(
        [
            T.StructField("doc_id", T.LongType(), False),
            T.StructField("quality", T.IntegerType(), False),
            T.StructField("score", T.DoubleType()),
        ]
    )
    checked = validate.conforms(results, declared)
    routed = validate.route_errors(checked, "scores", "scores.errors", "score")
    return routed.select("doc_id", "topic", validate.messages().alias("problems"))


@query(r"""
SELECT doc_id, regexp_replace(lower(regexp_replace(text, '^\s+|\s+$', '', 'g')), '[^\p{L}\p{N}\s]', '', 'g') AS text
FROM documents
""")
def text_clean(t: Tables):
    steps = ["trim", "lowercase", "remove_special_chars"]
    return t.documents.select("doc_id", normalize.clean_text(F.col("text"), steps).alias("text"))


@query("""
SELECT event_id, value, CAST(hour(ts) AS BIGINT) AS tx_hour, value > 100 AS is_high_value, user_id * 2 AS doubled FROM events
""")
def features(t: Tables):
    wanted = ["value", "tx_hour", "is_high_value: value > 100", "doubled: user_id * 2"]
    return normalize.features(t.events, wanted, keep=["event_id"])


@query("""
SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN o_orderdate ELSE TIMESTAMP '1970-01-01' END AS ordered_at FROM orders
""")
def normalize_dates(t: Tables):
    text = (
        F.when(F.col("o_orderstatus") == "O", F.date_format("o_orderdate", "yyyy-MM-dd"))
        .when(F.col("o_orderstatus") == "F", F.date_format("o_orderdate", "dd/MM/yyyy"))
        .otherwise("soon")
    )
    mixed = t.orders.select("o_orderkey", text.alias("d"))
    parsed = normalize.parse_date(F.col("d"), ["yyyy-MM-dd", "dd/MM/yyyy"])
    epoch = F.lit("1970-01-01").cast("timestamp_ntz")
    return mixed.select("o_orderkey", F.coalesce(parsed.cast("timestamp_ntz"), epoch).alias("ordered_at"))


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
       coalesce(round(l_quantity * CASE l_returnflag WHEN 'A' THEN 1.0 WHEN 'R' THEN 0.001 END, 6), -1) AS kg
FROM lineitem
""")
def normalize_units(t: Tables):
    unit = F.when(F.col("l_returnflag") == "A", "kg").when(F.col("l_returnflag") == "R", "g").otherwise("box")
    kg = normalize.convert(F.col("l_quantity"), unit, {"kg": 1.0, "g": 0.001})
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.coalesce(F.round(kg, 6), F.lit(-1.0)).alias("kg"))


@query("SELECT c_custkey AS id, c_name AS name, c_nationkey AS country FROM customer")
def normalize_rename(t: Tables):
    config = normalize.Normalization(
        rename={"c_custkey": "id", "c_name": "name", "c_nationkey": "country"}, drop=["c_acctbal", "c_mktsegment"]
    )
    return normalize.normalize(t.customer, config)


@query("""
SELECT o_orderkey AS id, o_orderdate AS ordered_at, round(o_totalprice * 0.01, 6) AS price, lower(o_orderpriority) AS priority
FROM orders
""")
def data_normalizer(t: Tables):
    text_dates = t.orders.withColumn("o_orderdate", F.date_format("o_orderdate", "yyyyMMdd")).drop("o_custkey")
    config = normalize.Normalization(
        dates={"o_orderdate": ["yyyy-MM-dd", "yyyyMMdd"]},
        scale={"o_totalprice": 0.01},
        text={"o_orderpriority": ["trim", "lowercase"]},
        rename={"o_orderkey": "id", "o_orderdate": "ordered_at", "o_totalprice": "price", "o_orderpriority": "priority"},
        drop=["o_orderstatus"],
    )
    done = normalize.normalize(text_dates, config)
    return done.withColumns({"ordered_at": F.col("ordered_at").cast("timestamp_ntz"), "price": F.round("price", 6)})


@query(f"WITH e AS ({PARTIAL_SQL}) SELECT event_id, round(coalesce(value, avg(value) OVER ()), 6) AS value FROM e")
def impute_mean(t: Tables):
    events = partial_events(t.events).select("event_id", "value")
    filled = impute.impute(events, ["value"], "mean_imputation")
    return filled.withColumn("value", F.round("value", 6))


@query(f"WITH e AS ({PARTIAL_SQL}) SELECT event_id, round(coalesce(value, (SELECT median(value) FROM e)), 6) AS value FROM e")
def impute_median(t: Tables):
    events = partial_events(t.events).select("event_id", "value")
    filled = impute.impute(events, ["value"], "median_imputation")
    return filled.withColumn("value", F.round("value", 6))
