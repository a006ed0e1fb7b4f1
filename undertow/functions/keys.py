"""Keys of nodes: the namespace (a repository's full name) and what tells a node apart in it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The marks that stand between the parts of a key.


def file_key(namespace: Column, path: Column) -> Column:
    return F.concat(namespace, F.lit(":"), path)


def symbol_key(namespace: Column, path: Column, name: Column) -> Column:
    """Symbols of one name in a file are one symbol."""
    return F.concat(file_key(namespace, path), F.lit("::"), name)


def screen_key(namespace: Column, screen_id: Column) -> Column:
    return F.concat(namespace, F.lit("::screen::"), screen_id)


def requirement_key(namespace: Column, req_id: Column) -> Column:
    return F.concat(namespace, F.lit("::req::"), req_id)


def gap_key(namespace: Column, req_id: Column) -> Column:
    return F.concat(requirement_key(namespace, req_id), F.lit("::gap"))
