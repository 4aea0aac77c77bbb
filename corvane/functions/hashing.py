"""Content keys: SHA-256 over a compact JSON of named fields in a fixed order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Stands for null, which must differ from any value.
NOTHING = "\u0000none"


def key_of(**fields: Column) -> Column:
    """The key of the fields in alphabetical order; a changed, added or nulled field changes it."""
    parts = [F.concat(F.lit(f"{name}="), F.coalesce(fields[name].cast("string"), F.lit(NOTHING))) for name in sorted(fields)]
    return F.sha2(F.array_join(F.array(*[F.concat(F.length(p).cast("string"), F.lit(":"), p) for p in parts]), "\n"), 256)


def request_key(role: Column, prompt: Column, model: Column, temperature: Column, context_id: Column) -> Column:
    """Of one request to a language model."""
    return key_of(role=role, prompt=prompt, model=model, temperature=temperature.cast("double"), context=context_id)


def embedding_key(kind: Column, text: Column, model: Column) -> Column:
    return key_of(kind=kind, text=text, model=model)


def retrieval_key(query: Column, options: Column, top_k: Column, index: Column, settings: Column) -> Column:
    """Of one retrieval, over everything its result depends on."""
    return key_of(query=query, options=options, top_k=top_k, index=index, settings=settings)


def context_id(ranked_ids: Column) -> Column:
    """Of the ids of passages in the order of their ranks."""
    return F.sha2(F.array_join(ranked_ids, ","), 256)


def sub_seed(seed: Column, label: Column) -> Column:
    """The first 8 bytes of the hash of "seed:label", as an unsigned number."""
    return F.conv(F.substring(F.sha2(F.concat_ws(":", seed.cast("string"), label), 256), 1, 16), 16, 10).cast("decimal(20,0)")


def sample_order(seed: int, label: str, id_: Column) -> Column:
    """The order in which a seeded sample takes rows."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(label), id_.cast("string")))
