"""Spellings in which Spark SQL and the checking engine differ, so that a query is stated once."""

from __future__ import annotations


class Spark:
    name = "spark"
    #: An ASCII edge of a word: the engine's own would see letters beyond ASCII.
    begin, edge = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"
    string, double = "string", "double"
    #: White space as the checking engine has it: without the vertical tab.
    space = "[ \\t\\n\\f\\r]"

    div = staticmethod(lambda a, b: f"(({a}) div ({b}))")
    days = staticmethod(lambda later, earlier: f"cast(datediff({later}, {earlier}) as bigint)")
    plus_days = staticmethod(lambda d, n: f"date_add({d}, cast({n} as int))")
    iso = staticmethod(lambda d: f"date_format({d}, 'yyyy-MM-dd')")
    words = staticmethod(lambda c: f"cast(regexp_count({c}, r'[^ \\t\\n\\f\\r]+') as bigint)")
    sub = staticmethod(lambda c, pattern, to: f"regexp_replace({c}, r'{pattern}', '{to}')")
    extract = staticmethod(lambda c, pattern, k=1: f"regexp_extract({c}, r'{pattern}', {k})")
    like = staticmethod(lambda c, pattern: f"({c} rlike r'{pattern}')")
    hits = staticmethod(lambda c, pattern: f"cast(size(regexp_extract_all({c}, r'{pattern}', 0)) as bigint)")
    every = staticmethod(lambda c, pattern, k=0: f"regexp_extract_all({c}, r'{pattern}', {k})")
    split = staticmethod(lambda c, mark: f"split({c}, r'{Spark.space + '+' if mark == chr(92) + 's+' else mark}')")
    at = staticmethod(lambda a, k: f"element_at({a}, {k})")
    size = staticmethod(lambda a: f"cast(size({a}) as bigint)")
    slice = staticmethod(lambda a, i, n: f"slice({a}, {i}, {n})")
    join = staticmethod(lambda a, mark: f"array_join({a}, '{mark}')")
    explode = staticmethod(lambda table, array, name: f"{table} lateral view explode({array}) as {name}")
    posexplode = staticmethod(lambda table, array, pos, name: f"{table} lateral view posexplode({array}) as {pos}, {name}")
    count_if = staticmethod(lambda c: f"cast(count_if({c}) as bigint)")
    any = staticmethod(lambda c: f"bool_or({c})")
    median = staticmethod(lambda c: f"percentile({c}, 0.5)")
    low_median = staticmethod(lambda c: f"cast(percentile_disc(0.5) within group (order by {c}) as bigint)")
    cos = staticmethod(lambda a, b: f"(aggregate(zip_with({a}, {b}, (x, y) -> cast(x as double) * y), 0D, (s, x) -> s + x) / sqrt(aggregate({a}, 0D, (s, x) -> s + cast(x as double) * x)) / sqrt(aggregate({b}, 0D, (s, x) -> s + cast(x as double) * x)))")
    listed = staticmethod(lambda c, order: f"array_join(transform(array_sort(collect_list(struct({order} as o, {c} as v))), t -> t.v), ',')")
    set_listed = staticmethod(lambda c: f"array_join(array_sort(collect_set({c})), ',')")
    first_by = staticmethod(lambda c, order: f"min_by({c}, {order})")
    last_by = staticmethod(lambda c, order: f"max_by({c}, {order})")
    pair = staticmethod(lambda *c: f"struct({', '.join(c)})")
    range = staticmethod(lambda a, b: f"sequence({a}, {b})")
    sha = staticmethod(lambda c: f"sha2({c}, 256)")
    locate = staticmethod(lambda part, c: f"cast(locate({part}, {c}) as bigint)")
    json_int = staticmethod(lambda c, key: f"cast(get_json_object({c}, '$.{key}') as bigint)")
    json_str = staticmethod(lambda c, key: f"get_json_object({c}, '$.{key}')")
    day = staticmethod(lambda c: f"cast({c} as date)")
    hours = staticmethod(lambda later, earlier: f"(cast(floor((unix_seconds(cast({later} as timestamp)) - unix_seconds(cast({earlier} as timestamp))) / 3600) as bigint))")
    stamp = staticmethod(lambda c: f"date_format({c}, 'yyyy-MM-dd HH:mm:ss')")
    count_in = staticmethod(lambda a, words: f"cast(size(filter({a}, w -> w in ({', '.join(repr(w) for w in words)}))) as bigint)")
    secs = staticmethod(lambda c: f"unix_seconds(cast({c} as timestamp))")
    grams = staticmethod(lambda c, n: f"transform(sequence(1, greatest(length({c}) - {n - 1}, 1)), i -> substring({c}, i, {n}))")
    try_number = staticmethod(lambda c: f"try_cast({c} as double)")
    unpivot = staticmethod(lambda table, kept, names, key, value: f"select {', '.join(kept)}, {key}, {value} from {table} lateral view stack({len(names)}, {', '.join(f"'{n}', {n}" for n in names)}) as {key}, {value}")
    values = staticmethod(lambda rows, *names: f"(select * from values {', '.join(rows)} as t({', '.join(names)}))")
    months = staticmethod(lambda d, n: f"add_months({d}, {n})")


class Duck:
    name = "duckdb"
    begin, edge = "\\b", "\\b"
    string, double = "varchar", "double"

    div = staticmethod(lambda a, b: f"(({a}) // ({b}))")
    days = staticmethod(lambda later, earlier: f"date_diff('day', {earlier}, {later})")
    plus_days = staticmethod(lambda d, n: f"cast({d} + to_days(cast({n} as int)) as date)")
    iso = staticmethod(lambda d: f"strftime({d}, '%Y-%m-%d')")
    words = staticmethod(lambda c: f"(case when regexp_replace({c}, '^\\s+|\\s+$', '', 'g') = '' then 0 else cast(len(string_split_regex(regexp_replace({c}, '^\\s+|\\s+$', '', 'g'), '\\s+')) as bigint) end)")
    sub = staticmethod(lambda c, pattern, to: f"regexp_replace({c}, '{pattern}', '{to}', 'g')")
    extract = staticmethod(lambda c, pattern, k=1: f"regexp_extract({c}, '{pattern}', {k})")
    like = staticmethod(lambda c, pattern: f"regexp_matches({c}, '{pattern}')")
    hits = staticmethod(lambda c, pattern: f"cast(len(regexp_extract_all({c}, '{pattern}')) as bigint)")
    every = staticmethod(lambda c, pattern, k=0: f"regexp_extract_all({c}, '{pattern}', {k})")
    split = staticmethod(lambda c, mark: f"string_split_regex({c}, '{mark}')")
    at = staticmethod(lambda a, k: f"({a})[{k}]")
    size = staticmethod(lambda a: f"cast(len({a}) as bigint)")
    slice = staticmethod(lambda a, i, n: f"({a})[{i}:({i}) + ({n}) - 1]")
    join = staticmethod(lambda a, mark: f"array_to_string({a}, '{mark}')")
    explode = staticmethod(lambda table, array, name: f"(select *, unnest({array}) as {name} from {table})")
    posexplode = staticmethod(lambda table, array, pos, name: f"(select *, unnest({array}) as {name}, unnest(range(0, len({array}))) as {pos} from {table})")
    count_if = staticmethod(lambda c: f"cast(count(*) filter (where {c}) as bigint)")
    any = staticmethod(lambda c: f"bool_or({c})")
    median = staticmethod(lambda c: f"quantile_cont({c}, 0.5)")
    low_median = staticmethod(lambda c: f"cast(quantile_disc({c}, 0.5) as bigint)")
    cos = staticmethod(lambda a, b: f"list_cosine_similarity(cast({a} as double[]), cast({b} as double[]))")
    listed = staticmethod(lambda c, order: f"string_agg(cast({c} as varchar), ',' order by {order})")
    set_listed = staticmethod(lambda c: f"string_agg(distinct {c}, ',' order by {c})")
    first_by = staticmethod(lambda c, order: f"arg_min({c}, {order})")
    last_by = staticmethod(lambda c, order: f"arg_max({c}, {order})")
    pair = staticmethod(lambda *c: f"row({', '.join(c)})")
    range = staticmethod(lambda a, b: f"range({a}, ({b}) + 1)")
    sha = staticmethod(lambda c: f"sha256({c})")
    locate = staticmethod(lambda part, c: f"cast(strpos({c}, {part}) as bigint)")
    json_int = staticmethod(lambda c, key: f"cast(json_extract_string({c}, '$.{key}') as bigint)")
    json_str = staticmethod(lambda c, key: f"json_extract_string({c}, '$.{key}')")
    day = staticmethod(lambda c: f"cast({c} as date)")
    hours = staticmethod(lambda later, earlier: f"cast(floor((epoch({later}) - epoch({earlier})) / 3600) as bigint)")
    stamp = staticmethod(lambda c: f"strftime({c}, '%Y-%m-%d %H:%M:%S')")
    count_in = staticmethod(lambda a, words: f"cast(len(list_filter({a}, lambda w: w in ({', '.join(repr(w) for w in words)}))) as bigint)")
    secs = staticmethod(lambda c: f"cast(floor(epoch({c})) as bigint)")
    grams = staticmethod(lambda c, n: f"list_transform(range(1, greatest(length({c}) - {n - 1}, 1) + 1), lambda i: substring({c}, i, {n}))")
    try_number = staticmethod(lambda c: f"try_cast({c} as double)")
    unpivot = staticmethod(lambda table, kept, names, key, value: " union all ".join(f"select {', '.join(kept)}, '{n}' as {key}, {n} as {value} from {table}" for n in names))
    values = staticmethod(lambda rows, *names: f"(select * from (values {', '.join(rows)}) as t({', '.join(names)}))")
    months = staticmethod(lambda d, n: f"cast({d} + to_months({n}) as date)")
