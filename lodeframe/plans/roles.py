"""The driver's tables seen in the roles that the operators work on.

Each role is one SELECT that Spark and DuckDB read alike, so a query and its oracle start from
the same rows.  ``role(spark, sf_dir, name)`` gives the DataFrame, ``with_roles(sql)`` puts the
roles that a statement names in front of it.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

ROLES: dict[str, str] = {
    # Sources of catalogue rows: 25 of them; two hold no rows.
    "sources": "select cast(n_nationkey + 1 as bigint) as pk, lower(n_name) as skey, n_name as name, n_regionkey as region, n_nationkey % 7 as ordinal, case when n_nationkey % 3 = 0 then 'LOCAL_FILE' else 'GOOGLE_DRIVE' end as source_type from nation",
    # Catalogue rows.
    "cards": """select p_partkey as pk, concat('c', cast(p_partkey as string)) as identifier,
        concat(p_name, ' ', translate(cast(p_partkey - p_partkey % 640 as string), '0123456789', 'abcdefghij'), case p_partkey % 5 when 0 then ' (Full Art)' when 1 then ' [Foil, Alt]' when 2 then '-Token 2!' when 3 then ' (1)' else '' end) as name, concat(p_name, ' ', translate(cast(p_partkey - p_partkey % 640 as string), '0123456789', 'abcdefghij')) as base_name,
        case p_type when 'PROMO' then 'TOKEN' when 'SMALL' then 'CARDBACK' else 'CARD' end as card_type,
        cast(regexp_extract(p_brand, '[0-9]+', 0) as bigint) % 24 + 1 as source_pk, p_partkey % 12 as priority,
        case when p_partkey % 50 = 0 then null else p_size * 30 end as dpi, cast(p_retailprice * 20000 as bigint) as size,
        case p_partkey % 4 when 0 then 'EN' when 1 then 'FR' when 2 then 'DE' else 'EN' end as language,
        case when p_partkey % 9 = 0 then '' else concat(replace(p_name, ' ', ','), ',', lower(p_type)) end as tag_list,
        p_partkey * 7919 % 365 as created_day, p_partkey * 104729 % 365 as modified_day,
        case when p_partkey % 6 = 0 then p_partkey % 201 end as canonical_pk, case when p_partkey % 5 = 0 then p_partkey % 190 end as inferred_pk,
        case p_partkey % 3 when 0 then 'RESOLVED' when 1 then 'UNRESOLVED' else 'CONTESTED' end as status,
        case when p_partkey % 10 = 0 then '' when p_partkey % 11 = 0 then null else md5(cast(p_partkey - p_partkey % 4 as string)) end as md5,
        case when p_partkey % 13 = 0 then null else (p_partkey - p_partkey % 3) * 2654435761 % 4294967296 end as phash,
        case p_partkey % 8 when 0 then lower(concat('S', cast(p_size % 9 as string))) else '' end as expansion_hint
        from part""",
    # Known printings of the names.
    "printings": """select p_partkey as pk, concat(p_name, ' ', translate(cast(p_partkey - p_partkey % 640 as string), '0123456789', 'abcdefghij')) as name, concat('s', cast(p_size % 9 as string)) as set_code, lpad(cast(p_size as string), 3, '0') as number,
        p_type as artist, (p_partkey - p_partkey % 3) * 2654435761 % 4294967296 as image_hash, case p_partkey % 4 when 0 then 'borderless' when 1 then 'white' else 'black' end as border,
        p_partkey % 6 = 0 as full_art, case when p_partkey % 7 = 0 then null else p_partkey % 1000 end as popularity, 1993 + p_size % 30 as released_year, p_partkey % 97 as illustration,
        p_partkey % 150 as canonical_id, case p_partkey % 5 when 0 then 'transform' when 1 then 'split' else 'normal' end as layout from part where p_partkey % 3 = 0""",
    # Votes of one long table.
    "votes": """select event_id as pk, event_id % 997 as entity, event_type as outcome, event_type = 'error' as sentinel,
        case when user_id % 12 in (3, 9) then concat('engine', cast(user_id % 7 as string), '-v', cast(event_id % 3 + 1 as string)) when user_id % 40 = 11 then null else concat('user', cast(user_id as string)) end as agent,
        case user_id % 12 when 3 then 'ocr' when 9 then 'deduction' when 4 then 'federated' when 5 then 'implicit' when 2 then 'admin' else 'user' end as source,
        concat('run', cast(cast(regexp_extract(props, '[0-9]+', 0) as bigint) % 10 as string)) as run_id, ts, value, event_id % 5 as candidate, case when event_id % 3 = 0 then -1 else 1 end as polarity from events""",
    # An append-only log of scans.
    "scans": """select event_id as pk, event_id % 2003 as card_pk, concat('engine', cast(user_id % 4 as string)) as engine, concat('run', cast(event_id % 20 as string)) as run_id,
        case event_type when 'view' then 'no-text' when 'click' then 'ambiguous' when 'error' then 'no-match' when 'signup' then '' else 'unknown-set' end as reason, ts from events""",
    # Readings of a row's image, many for a row; '' means that nothing was found.
    "evidence": """select l_orderkey * 8 + l_linenumber as pk, l_partkey as card_pk, l_suppkey % 50 as content_hash, case when l_quantity < 8 then '' else concat('s', cast(l_suppkey % 11 as string)) end as set_code,
        case when l_quantity < 4 then '' else cast(l_suppkey % 50 + 1 as string) end as number, case l_returnflag when 'R' then 'black' when 'A' then 'white' else '' end as border,
        case l_suppkey % 4 when 0 then '' when 1 then 'PROMO' when 2 then 'STANDARD' else 'LARGE' end as artist, l_linestatus = 'F' and l_tax = 0 as truncated,
        case when l_discount = 0 then null else 1990 + cast(l_quantity as bigint) end as year, l_extendedprice as score, l_shipdate as updated_at, l_quantity as inset_a, l_discount * 500 as inset_b from lineitem""",
    # Tags with a hierarchy: tag k hangs under k / 3.
    "tags": "select cast(s_suppkey as bigint) as pk, concat('tag', cast(s_suppkey as string)) as name, case when s_suppkey = 0 then null else cast(floor(s_suppkey / 3) as bigint) end as parent_pk, s_nationkey % 4 = 0 as sensitive from supplier",
}

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def role(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A role as a DataFrame; only the columns that a query uses are read."""
    sql = ROLES[name]
    source = re.search(r"\bfrom (\w+)(?: where .*)?\s*$", sql, re.S)[1]
    head, tail = sql.rsplit(f"from {source}", 1)
    return spark.sql(f"{head}from {{source}}{tail}".replace("{source}", "{t}"), t=table(spark, sf_dir, source))


def with_roles(sql: str) -> str:
    """sql with the roles that it names defined in front."""
    used = [n for n in ROLES if re.search(rf"\b{n}\b", sql)]
    if not used:
        return sql
    roles = ", ".join(f"{n} as ({ROLES[n]})" for n in used)
    body = sql.strip()
    if body.lower().startswith("with recursive "):
        return f"with recursive {roles}, {body[15:]}"
    if body.lower().startswith("with "):
        return f"with {roles}, {body[5:]}"
    return f"with {roles} {body}"
