"""All queries over the reference's operators, by name, with their DuckDB SQL."""

from factloom.plans import documents, engine, pairs, values

QUERIES: dict = {**documents.QUERIES, **values.QUERIES, **pairs.QUERIES, **engine.QUERIES}
ORACLES: dict = {**documents.ORACLES, **values.ORACLES, **pairs.ORACLES, **engine.ORACLES}
