"""Records with everything that later stages need of them, normalised once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinmesh.functions import text as T


def normalise(records: DataFrame, strip_domain_words: bool = False) -> DataFrame:
    """records (entity_id, name, address, country) with name and address forms.

    On the feature path an address is cleaned twice, so that a cleaned 'null' is empty too; addr_clean is the address
    cleaned once, which the rule score uses.
    """
    once = records.select("entity_id", "name", "address", "country", T.clean_text(F.col("name")).alias("name_clean"), T.clean_text(F.col("address")).alias("addr_clean"))
    roots = once.select("*", T.root_tokens(F.col("name_clean"), strip_domain_words).alias("root"), T.address_runs(F.col("addr_clean")).alias("runs"))
    return roots.select(
        "entity_id", "name", "address", "country", "name_clean", "addr_clean",
        F.array_join("root", " ").alias("name_root"),
        F.coalesce(F.try_element_at("root", F.lit(1)), F.lit("")).alias("name_first"),
        F.array_join("root", "").alias("name_compact"),
        F.array_join("runs", " ").alias("addr_norm"),
        F.array_distinct("runs").alias("addr_tokens"),
        T.address_numbers(F.col("runs")).alias("addr_nums"),
        T.address_words(F.col("runs")).alias("addr_words"),
    )


def sql_normalise(source: str, strip_domain_words: bool = False) -> str:
    """The same as the CTE chain ``n1, n2, norm`` over a relation of records."""
    return f"""
    n1 as (select entity_id, name, address, country, {T.sql_clean('name')} as name_clean, {T.sql_clean('address')} as addr_clean from {source}),
    n2 as (select *, {T.sql_root('name_clean', strip_domain_words)} as root, {T.sql_runs('addr_clean')} as runs from n1),
    norm as (select entity_id, name, address, country, name_clean, addr_clean, array_to_string(root, ' ') as name_root,
                    coalesce(root[1], '') as name_first, array_to_string(root, '') as name_compact,
                    array_to_string(runs, ' ') as addr_norm, list_distinct(runs) as addr_tokens,
                    {T.sql_numbers('runs')} as addr_nums, {T.sql_words('runs')} as addr_words from n2)"""
