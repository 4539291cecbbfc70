"""Tool-call linking: calls meet their results by id, get a place in topological order, are validated
against schemas and serialised as canonical JSON. DataFrame and SQL functions only.

* Calls meet results by (``conv_id``, ``call_id``) where results bring a ``conv_id``: an id then belongs to its
  conversation. Results without that column meet calls by ``call_id`` alone, which must then be unique everywhere.
* Calls and results are first reduced to one row a key (combined map-side, so an id that is repeated over and
  over costs one row a task), then hash-joined. The rows left over are found by their own row number, so a hot
  id does not gather them in one task; each keeps its row and gets a status of its own.
* A call may use another call's result (``parent_id``). Its level is its distance from a call without
  parent, found by pointer doubling: after k rounds every call knows its 2**k-th ancestor, so a chain
  of a million calls takes twenty joins. Calls sorted by (``conv_id``, ``topo_level``, ``turn``,
  ``call_id``) are in topological order. Calls on a cycle, or below one, have no level.
* Arguments are parsed as VARIANT, whose JSON form has sorted keys and no blanks. Texts that do not parse, those
  that repeat a key among them, are kept as ``raw`` beside null arguments. Whole numbers may be written as 1.0.

Status, the first that holds: ``no_id`` (a null in the key links nothing), ``duplicate_call`` and
``duplicate_result`` (of rows that repeat a key the smallest, by conversation, turn, text, is linked, these are
the others), ``orphan_result`` (a result without call), ``cycle``, ``invalid`` (``errors`` says why),
``unanswered``, ``linked``. Rows of a result alone have null in all other columns; calls left over have no level.
``link_all`` gives every call and result; ``link`` leaves no_id and duplicates out. Null names are
unknown tools; null or broken arguments are errors. A parent that does not exist (in the conversation, where the
key has one) counts as none. Empty tables give an empty result; extra columns are not read; long texts are kept whole.
"""

from pyspark.sql import functions as F

from drawfield.llm.common import query, stored, table

#: tool -> field -> (type, required). Types: string, integer, boolean.
SCHEMAS = {
    "search": {"limit": ("integer", True), "query": ("string", True)},
    "lookup": {"exact": ("boolean", False), "key": ("string", True)},
    "summarize": {"max_words": ("integer", True), "text": ("string", True)},
}
_KINDS = {"string": "STRING", "integer": "BIGINT", "boolean": "BOOLEAN"}


def levels(calls, scope=()):
    """``scope``, ``call_id``, ``topo_level`` (null on or below a cycle) from ``scope``, ``call_id``, ``parent_id``.

    ``scope``: columns within which an id is unique and a parent is looked for; none for all calls.
    """
    known = calls.select(*scope, F.col("call_id").alias("parent_id"), F.lit(True).alias("exists"))
    start = calls.select(*scope, "call_id", "parent_id").join(known, [*scope, "parent_id"], "left")
    nodes = stored(start.select(*scope, "call_id", F.when(F.col("exists"), F.col("parent_id")).alias("up"),
                                F.when(F.col("exists"), 1).otherwise(0).cast("long").alias("steps")), "levels")
    reach, total = 1, nodes.count()
    while reach <= total and nodes.filter("up IS NOT NULL").limit(1).count():
        above = nodes.select(*scope, F.col("call_id").alias("up"), F.col("up").alias("further"), F.col("steps").alias("more"))
        nodes = stored(nodes.join(above, [*scope, "up"], "left").select(
            *scope, "call_id", F.col("further").alias("up"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps")), "levels")
        reach *= 2
    return nodes.select(*scope, "call_id", F.when(F.col("up").isNull(), F.col("steps").cast("int")).alias("topo_level"))


def errors_of(name, arguments, value, schemas=SCHEMAS):
    """The faults of a call as an array column; ``value``: the parsed arguments."""
    tool = F.coalesce(name, F.lit(""))
    found = [F.when(~tool.isin(*schemas), F.lit("unknown tool")),
             F.when(F.coalesce(~F.schema_of_variant(value).startswith("OBJECT"), F.lit(True)), F.lit("not an object"))]
    keys = F.coalesce(F.json_object_keys(arguments), F.array().cast("array<string>"))
    faults = F.array(*found)
    for known, fields in schemas.items():
        mine = []
        for field, (kind, required) in sorted(fields.items()):
            got = F.schema_of_variant(F.try_variant_get(value, f"$.{field}", "variant"))
            if required:
                mine.append(F.when(got.isNull(), F.lit(f"missing {field}")))
            fits = got == _KINDS[kind]
            if kind == "integer":
                # 1.0 is the whole number that its canonical form prints.
                fits = fits | got.rlike(r"^DECIMAL\(\d+,0\)$")
            mine.append(F.when(~fits, F.lit(f"type of {field}")))
        extra = F.transform(F.array_sort(F.array_except(keys, F.array(*map(F.lit, sorted(fields))))),
                            lambda k: F.concat(F.lit("unexpected "), k))
        faults = F.concat(faults, F.when(tool == known, F.concat(F.array(*mine), extra))
                          .otherwise(F.array().cast("array<string>")))
    return F.filter(faults, lambda x: x.isNotNull())


def _numbered(rows, purpose):
    """The rows with ``row``, a number of their own that stays the same as they are stored."""
    return stored(rows.withColumn("row", F.monotonically_increasing_id()), purpose)


def _apart(rows, key, purpose):
    """``(one, surplus)``: the smallest row of each key without nulls, and all other rows."""
    rest = [c for c in rows.columns if c not in key]
    whole = rows.dropna(subset=key)
    one = stored(whole.groupBy(*key).agg(F.min(F.struct(*rest)).alias("r")).select(*key, "r.*"), purpose)
    return one, rows.join(one.select("row"), "row", "left_anti")


def link_all(calls, results, schemas=SCHEMAS):
    """``call_id``, ``conv_id``, ``turn``, ``parent_id``, ``topo_level``, ``status``, ``errors``, ``canonical``.

    calls: ``call_id``, ``conv_id``, ``turn``, ``name``, ``arguments`` (JSON text), ``parent_id``.
    results: ``call_id``, ``content`` and, where ids belong to a conversation, ``conv_id``.
    Every call gives one row, and so does every result that does not stand in its call's row.
    """
    scope = ["conv_id"] if "conv_id" in results.columns else []
    key = [*scope, "call_id"]
    calls = _numbered(calls.select("call_id", "conv_id", "turn", "name", "arguments", "parent_id"), "calls")
    one_call, more_calls = _apart(calls, key, "calls")
    one_result, more_results = _apart(_numbered(results.select(*key, "content"), "results"), key, "results")
    surplus = F.when(F.expr(" OR ".join(f"{k} IS NULL" for k in key)), "no_id")
    called, answered = F.lit(True).alias("called"), F.lit(True).alias("answered")
    answers = one_result.select(*key, "content", answered)
    both = (one_call.select("*", called).join(levels(one_call, scope), key)
            .withColumn("surplus", F.lit(None).cast("string")).join(answers, key, "full"))
    left = (more_calls.select("*", called, surplus.otherwise("duplicate_call").alias("surplus"))
            .unionByName(more_results.select(*key, "content", answered, surplus.otherwise("duplicate_result").alias("surplus")),
                         allowMissingColumns=True))
    rows = both.unionByName(left, allowMissingColumns=True).withColumn("value", F.try_parse_json("arguments")).withColumn(
        "errors", F.when(F.col("called"), errors_of(F.col("name"), F.col("arguments"), F.col("value"), schemas)))
    status = (F.when(F.col("surplus").isNotNull(), F.col("surplus"))
              .when(F.col("called").isNull(), "orphan_result").when(F.col("topo_level").isNull(), "cycle")
              .when(F.size("errors") > 0, "invalid").when(F.col("answered").isNull(), "unanswered").otherwise("linked"))
    record = [F.col("value").alias("arguments"), F.col("call_id").alias("id"), F.col("name"),
              F.col("parent_id").alias("parent"), F.col("content").alias("result")]
    whole = {"ignoreNullFields": "false"}
    broken = F.col("value").isNull() & F.col("arguments").isNotNull()
    canonical = F.when(broken, F.to_json(F.struct(*record[:4], F.col("arguments").alias("raw"), record[4]), whole)) \
        .otherwise(F.to_json(F.struct(*record), whole))
    return rows.select("call_id", F.when(F.col("called"), F.col("conv_id")).alias("conv_id"), "turn", "parent_id",
                       "topo_level", status.alias("status"), "errors",
                       canonical.alias("canonical"))


def link(calls, results, schemas=SCHEMAS):
    """The rows of ``link_all`` that have a key and are the first of it."""
    return link_all(calls, results, schemas).filter("status NOT IN ('no_id', 'duplicate_call', 'duplicate_result')")


def _id(turn):
    """Null where the conversation or the turn is: such turns have nothing to be told apart by."""
    return F.md5(F.concat(F.col("conv_id").cast("string"), F.lit("/"), turn.cast("string")))


def calls_in(conversations):
    """Calls and results as the conversations imply them: each user turn asks a tool, the next
    assistant turn is its result, and a call builds on the user turn before it."""
    text, number = F.coalesce("text", F.lit("")), F.length(F.coalesce("text", F.lit(""))).cast("long")
    wrong = F.col("conv_id") % 5 == 0
    arguments = (
        F.when(F.col("turn") % 3 == 0, F.when(wrong, F.to_json(F.struct(text.alias("query"), number.cast("string").alias("limit"))))
               .otherwise(F.to_json(F.struct(text.alias("query"), number.alias("limit")))))
        .when(F.col("turn") % 3 == 1, F.when(wrong, F.to_json(F.struct(F.lit(True).alias("exact"))))
              .otherwise(F.to_json(F.struct(text.alias("key"), F.lit(True).alias("exact")))))
        .otherwise(F.when(wrong, F.to_json(F.struct(text.alias("text"), number.alias("max_words"), F.lit("on").alias("debug"))))
                   .otherwise(F.to_json(F.struct(text.alias("text"), number.alias("max_words"))))))
    name = F.when(F.col("turn") % 3 == 0, "search").when(F.col("turn") % 3 == 1, "lookup").otherwise("summarize")
    calls = conversations.filter("role = 'user'").select(
        _id(F.col("turn")).alias("call_id"), "conv_id", "turn", name.alias("name"), arguments.alias("arguments"),
        _id(F.col("turn") - 2).alias("parent_id"))
    results = conversations.filter("role = 'assistant'").select(
        _id(F.col("turn") - 1).alias("call_id"), "conv_id", F.col("text").alias("content"))
    return calls, results


SQL = """
WITH t AS (SELECT conv_id, turn, role, text, coalesce(text, '') AS body,
                  md5(conv_id || '/' || turn) AS id, conv_id % 5 = 0 AS wrong FROM conversations),
calls AS (
  SELECT *, CASE turn % 3 WHEN 0 THEN 'search' WHEN 1 THEN 'lookup' ELSE 'summarize' END AS tool,
         md5(conv_id || '/' || (turn - 2)) AS up,
         turn - 2 * row_number() OVER (PARTITION BY conv_id, turn % 2 ORDER BY turn) AS island
  FROM t WHERE role = 'user'),
placed AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY conv_id, turn % 2, island ORDER BY turn) - 1 AS INTEGER) AS topo_level,
    CASE tool
      WHEN 'search' THEN '{"limit":' || CASE WHEN wrong THEN '"' || length(body) || '"' ELSE '' || length(body) END
                         || ',"query":' || to_json(body) || '}'
      WHEN 'lookup' THEN CASE WHEN wrong THEN '{"exact":true}' ELSE '{"exact":true,"key":' || to_json(body) || '}' END
      ELSE CASE WHEN wrong THEN '{"debug":"on",' ELSE '{' END || '"max_words":' || length(body) || ',"text":' || to_json(body) || '}'
    END AS args,
    CASE WHEN NOT wrong THEN '' WHEN tool = 'search' THEN 'type of limit' WHEN tool = 'lookup' THEN 'missing key'
         ELSE 'unexpected debug' END AS errors FROM calls),
results AS (SELECT md5(conv_id || '/' || (turn - 1)) AS id, text AS content FROM t WHERE role = 'assistant')
SELECT coalesce(p.id, r.id) AS call_id, p.conv_id, p.turn, p.up AS parent_id, p.topo_level,
       CASE WHEN p.id IS NULL THEN 'orphan_result' WHEN errors <> '' THEN 'invalid'
            WHEN r.id IS NULL THEN 'unanswered' ELSE 'linked' END AS status,
       errors,
       '{"arguments":' || coalesce(args, 'null') || ',"id":"' || coalesce(p.id, r.id) || '","name":'
       || coalesce('"' || tool || '"', 'null') || ',"parent":' || coalesce('"' || p.up || '"', 'null')
       || ',"result":' || coalesce(CAST(to_json(content) AS VARCHAR), 'null') || '}' AS canonical
FROM placed p FULL JOIN results r ON p.id = r.id
"""


@query("op10_tool_calls", SQL)
def op10_tool_calls(spark, sf_dir):
    rows = link_all(*calls_in(table(spark, sf_dir, "conversations")))
    return rows.withColumn("errors", F.array_join("errors", ", "))
