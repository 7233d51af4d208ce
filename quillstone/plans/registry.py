"""Registration of queries with their SQL, and the pieces of SQL that several of them share."""

from __future__ import annotations

from collections.abc import Callable

from quillstone.functions.text import WHITE
from quillstone.sources.corpus import ARRAYS, TEXTS


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Callable] = {}
        self.oracles: dict[str, str] = {}

    def query(self, sql: str | None = None) -> Callable:
        def add(f: Callable) -> Callable:
            self.queries[f.__name__] = f
            if sql:
                self.oracles[f.__name__] = sql
            return f

        return add


CHARS = "||".join(f"chr({ord(c)})" for c in WHITE)


def strip(x: str) -> str:
    return f"trim({x}, {CHARS})"


def ws(x: str) -> str:
    return rf"trim(regexp_replace({x}, '[\s\x0B\x{{85}}\pZ]+', ' ', 'g'))"


def fp(x: str) -> str:
    return rf"regexp_replace(lower({x}), '[\s\x0B\x{{85}}\pZ]+', '', 'g')"


def camel(x: str) -> str:
    return ws(rf"regexp_replace(regexp_replace({x}, '[_/]+', ' ', 'g'), '([a-z0-9])([A-Z])', '\1 \2', 'g')")


def hint(x: str) -> str:
    return rf"regexp_replace(regexp_replace(lower({ws(x)}), '^[^a-z0-9]+', ''), '[^a-z0-9]+$', '')"


def words(items: list[str]) -> str:
    return "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in items) + ")"


CORPUS = f"""corpus as materialized (
  select row_id, doc_id, coalesce(doc_type, 'clause_doc') as doc_type, coalesce(content_kind, 'clause') as content_kind,
         coalesce({strip('spec_no')}, '') as spec_no, coalesce({strip('clause_id')}, '') as clause_id,
         {', '.join(f"coalesce({c}, '') as {c}" for c in TEXTS)},
         {', '.join(f"list_filter(coalesce({c}, []), lambda x: x is not null) as {c}" for c in ARRAYS)}
  from records where doc_id is not null
  qualify row_number() over (partition by doc_id order by indexed_at desc nulls last, row_id desc) = 1)"""
