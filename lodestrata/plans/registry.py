"""All queries of the library and their SQL, by name."""

from __future__ import annotations

from importlib import import_module

_QUERIES: dict = {}
_SQL: dict[str, str] = {}
_MODULES = ["documents", "relational", "analytics", "graphs", "workflow", "projects", "reviews", "models", "learners", "pages", "languages"]


def query(name: str, sql: str | None = None):
    """Registers a function of (table loader by name) -> DataFrame."""

    def add(f):
        def run(spark, folder):
            from lodestrata.tables import table

            return f(lambda t: table(spark, folder, t))

        _QUERIES[name] = run
        if sql:
            _SQL[name] = sql
        return f

    return add


def _load() -> None:
    for m in _MODULES:
        import_module(f"lodestrata.plans.{m}")


def queries() -> dict:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
