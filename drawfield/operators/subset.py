"""Subset queries over month x cell x target x draw."""

from pyspark.sql import functions as F

from drawfield.functions.draws import pick_draws
from drawfield.operators.normalize import is_vector
from drawfield.schema import CELL, GEO_COLUMNS, LEVEL_NAMES, MONTH, level_column

INLINE_IDS = 1000    # a longer list of ids is joined instead of compared one by one


def _listed(values):
    return list(values) if isinstance(values, (list, tuple, set, range)) else [values]


def keep_ids(frame, column, ids):
    """Rows whose id is wanted: a short list becomes a pushed-down filter, any other a semi join."""
    if ids is None:
        return frame
    if hasattr(ids, "columns"):
        return frame.join(ids.select(F.col(ids.columns[0]).alias(column)), column, "left_semi")
    wanted = _listed(ids)
    if len(wanted) > INLINE_IDS:
        table = frame.sparkSession.createDataFrame([(i,) for i in wanted], frame.select(column).schema)
        return frame.join(table.distinct(), column, "left_semi")
    return frame.filter(F.col(column).isin(*wanted)) if wanted else frame.limit(0)


def subset(frame, targets, months=None, cells=None, features=None, draws=None, strict=False):
    """Rows of the wanted months and cells, the wanted targets, the wanted draws.

    ``None`` means all, an empty list nothing. Unknown ids simply match no row unless ``strict``.
    """
    chosen = list(targets) if features is None else _listed(features)
    unknown = [c for c in chosen if c not in targets]
    if unknown:
        raise ValueError(f"unknown targets {unknown}; this frame has {list(targets)}")
    if strict:
        require_known(frame, MONTH, months)
        require_known(frame, CELL, cells)
    rows = keep_ids(keep_ids(frame, MONTH, months), CELL, cells)
    if draws is None:
        return rows.select(MONTH, CELL, *chosen)
    if not all(is_vector(frame, c) for c in chosen):
        raise ValueError("draws can only be chosen from vector columns")
    return rows.select(MONTH, CELL, *[pick_draws(F.col(c), draws).alias(c) for c in chosen])


def unknown_ids(frame, column, requested):
    """Requested ids (a one-column DataFrame) that never occur."""
    wanted = requested.select(F.col(requested.columns[0]).alias(column))
    return wanted.join(frame.select(column), column, "left_anti").distinct()


def require_known(frame, column, ids):
    if ids is None:
        return
    spark = frame.sparkSession
    requested = ids if hasattr(ids, "columns") else spark.createDataFrame(
        [(i,) for i in _listed(ids)] or [], frame.select(column).schema)
    missing = [r[0] for r in unknown_ids(frame, column, requested).limit(10).collect()]
    if missing:
        raise KeyError(f"unknown {column}: {missing}")


def subset_ordered(frame, requested, column=CELL, strict=False):
    """Rows of the requested ids with ``position``, the place of the id in the request.

    Unknown ids match no row, or are an error if ``strict``.
    """
    if strict:
        require_known(frame, column, requested.select("id"))
    return frame.join(requested.select(F.col("position"), F.col("id").alias(column)), column)


def subset_ordered_block(frame, months, cells, strict=False):
    """Rows of requested months and cells with ``month_position`` and ``cell_position``, their places in the requests.

    Both requests are tables of ``id`` and ``position``; an id named twice gives its rows twice. Unknown ids
    of either match no row, or are an error if ``strict``; a NULL id is unknown. The joined keys are
    narrow, and a request that is small is sent to the tasks by Spark itself.
    """
    axes = ((MONTH, months, "month_position"), (CELL, cells, "cell_position"))
    if strict:
        for column, requested, _ in axes:
            require_known(frame, column, requested.select("id"))
    for column, requested, place in axes:
        frame = frame.join(requested.select(F.col("position").alias(place), F.col("id").alias(column)), column)
    return frame


def cells_of_unit(geo, level, codes):
    """Cells whose unit code at a level is one of ``codes``; an unknown code gives none."""
    return geo.filter(F.col(level_column(level)).isin(*_listed(codes))).select(CELL)


def subset_at_level(frame, geo, targets, level=None, codes=None, with_geo=True, **wanted):
    """Cell-level subset, the cells given by a level's unit codes, geography joined if asked."""
    if codes is not None and level is None:
        raise ValueError("unit codes need a level")
    if codes is not None:
        wanted["cells"] = cells_of_unit(geo, level, codes)
    rows = subset(frame, targets, **wanted)
    return rows.join(geo.select(CELL, *GEO_COLUMNS), CELL, "left") if with_geo else rows


def level_columns(level):
    """The unit column of a level and the columns it carries along."""
    return [level_column(level), *LEVEL_NAMES[level]]


def unit_encoding(geo, level):
    """Unit codes of a level and their rank from 1, a stable integer stand-in for text codes.

    Works on the distinct codes, combined map-side: at most as many values as there are
    administrative units of that level, however many cells there are.
    """
    codes = geo.agg(F.sort_array(F.collect_set(level_column(level))).alias("codes"))
    return codes.select(F.posexplode("codes").alias("position", "code")).select(
        "code", (F.col("position") + 1).alias("unit_id"))


def parse_requests(requests, column, kind="long"):
    """Parse comma lists of integers, or of texts with ``kind="string"``: ``ids`` NULL means all,
    ``valid`` false an odd element."""
    text = F.trim(F.coalesce(F.col(column), F.lit("")))
    parts = F.transform(F.split(text, ","), lambda p: F.trim(p))
    numbers = F.transform(F.filter(parts, lambda p: p != ""), lambda p: p.try_cast(kind))
    everything = (text == "") | text.isin("[]", "null", "None")
    return requests.withColumns({
        "selects_all": everything,
        "valid": everything | F.forall(numbers, lambda n: n.isNotNull()),
        "ids": F.when(~everything & F.forall(numbers, lambda n: n.isNotNull()), numbers),
    })


def answer_requests(frame, requests, column, keys):
    """Rows of ``frame`` for every valid request of ids, all requests in one join.

    requests: ``keys`` and what :func:`parse_requests` adds. A request of everything is answered by the
    frame itself and not multiplied out here. An id asked twice in a request answers once.
    """
    asked = (requests.filter("valid AND NOT selects_all")
             .select(*keys, F.explode(F.array_distinct("ids")).alias(column)))
    return asked.join(frame, column)


def summarize_requests(frame, requests, column, keys, value):
    """One row for every valid request: ``rows``, the sum of ``value``, the first and last month of its answer.

    A request of everything is answered by the whole frame, and one of unknown ids by no rows. Ids are
    summarized once before they meet the requests, so no row of the frame is multiplied by the requests for it.
    """
    def summary(rows, total, first, last):
        return [rows.cast("long").alias("rows"), total.alias(value), first.alias("first_month"), last.alias("last_month")]

    per_id = frame.groupBy(column).agg(*summary(F.count("*"), F.sum(value), F.min(MONTH), F.max(MONTH)))
    whole = per_id.agg(*summary(F.coalesce(F.sum("rows"), F.lit(0)), F.sum(value), F.min("first_month"), F.max("last_month")))
    valid = requests.filter("valid")
    asked = valid.filter("NOT selects_all").select(*keys, F.explode(F.array_distinct("ids")).alias(column))
    some = asked.join(per_id, column, "left").groupBy(*keys).agg(
        *summary(F.coalesce(F.sum("rows"), F.lit(0)), F.sum(value), F.min("first_month"), F.max("last_month")))
    every = valid.filter("selects_all").select(*keys, *[whole.select(c).scalar().alias(c) for c in whole.columns])
    return some.unionByName(every)


def coverage(frame, geo):
    """Per month and country: rows, and distinct cells."""
    return (frame.join(geo.select(CELL, "country_iso_a3"), CELL, "left")
            .groupBy(MONTH, "country_iso_a3")
            .agg(F.count("*").alias("rows"), F.countDistinct(CELL).alias("cells")))


def country_present(frame, geo, iso3):
    """Per month: rows, and whether a country is among them."""
    return (frame.join(geo.select(CELL, "country_iso_a3"), CELL, "left").groupBy(MONTH)
            .agg(F.count("*").alias("rows"),
                 F.coalesce(F.bool_or(F.col("country_iso_a3") == iso3), F.lit(False)).alias("present")))


