"""Search expressions for the services that documents come from."""

from __future__ import annotations

from ferrosieve.config import DOMAIN_QUERIES


def _clauses(domains: list[str] | None, table: dict[str, str]) -> list[str]:
    return [f"({table[d]})" for d in domains or [] if d in table]


def paper_query(domains: list[str] | None = None, category: str = "cs.CV", start: str = "2023", end: str = "2026", table: dict[str, str] = DOMAIN_QUERIES) -> str:
    """Category, any of the domains, and the years; unknown domains are left out."""
    clauses = _clauses(domains, table)
    middle = [f"({' OR '.join(clauses)})"] if clauses else []
    return " AND ".join([f"cat:{category}", *middle, f"submittedDate:[{start}01010000 TO {end}12312359]"])


def patent_query(domains: list[str] | None = None, start: str = "2020", end: str = "2025", table: dict[str, str] = DOMAIN_QUERIES) -> str:
    """Words of the abstract and the publication years; a general phrase where no domain is known."""
    clauses = _clauses(domains, table) or ['("autonomous vehicle" OR "ADAS")']
    return f'ab=({" OR ".join(clauses)}) and pd within "{start} {end}"'
