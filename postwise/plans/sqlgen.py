"""Small SQL builders for the DuckDB oracles (keyword lists are data, the logic is
written out in SQL per query)."""

from __future__ import annotations

from .. import config as C


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def any_contains(expr: str, words) -> str:
    return "(" + " OR ".join(f"contains({expr}, {lit(w)})" for w in words) + ")"


def low(expr: str) -> str:
    return f"lower(coalesce({expr}, ''))"


def is_loc(expr: str) -> str:
    return any_contains(low(expr), C.LOCATION_WORDS)


def is_role(expr: str) -> str:
    t = low(expr)
    return (f"({any_contains(t, C.TARGET_ROLES)} OR ({any_contains(t, C.SENIORITY_WORDS)} "
            f"AND {any_contains(t, C.CRAFT_WORDS)}))")


def nz(expr: str) -> str:
    """'' → NULL."""
    return f"nullif({expr}, '')"


def rule_score(title="job_title", notes="notes", company="company", description="description",
               visa="visa_support", reloc="relocation_support") -> str:
    t = f"lower(concat_ws(' ', coalesce({title}, ''), coalesce({notes}, ''), coalesce({company}, '')))"
    x = f"({t} || ' ' || lower(coalesce({description}, '')))"
    roles = " , ".join(f"CASE WHEN contains({t}, {lit(r)}) THEN {p} ELSE 0 END" for r, p in C.ROLE_WEIGHTS)
    skills = " + ".join(f"CASE WHEN contains({x}, {lit(s)}) THEN 1 ELSE 0 END" for s in dict.fromkeys(C.SKILL_TERMS))
    lang = any_contains(x, C.LANGUAGE_PHRASES)
    return (
        f"CAST(least(greatest(greatest(0, {roles}) + least(3 * ({skills}), 70)"
        f" - CASE WHEN contains({t}, 'staff ') OR contains({t}, ' staff') OR contains({t}, 'principal') THEN 20 ELSE 0 END"
        f" - CASE WHEN {visa} = FALSE THEN 20 ELSE 0 END"
        f" - CASE WHEN {reloc} = FALSE THEN 10 ELSE 0 END"
        f" - CASE WHEN {lang} THEN 30 ELSE 0 END, 0), 99) AS INTEGER)"
    )


def band(score: str) -> str:
    return (f"CASE WHEN {score} >= 75 THEN '#22c55e' WHEN {score} >= 55 THEN '#f59e0b' "
            f"ELSE '#94a3b8' END")


def fmt_date(expr: str) -> str:
    e = f"trim(coalesce({expr}, ''))"
    return (f"coalesce(nullif(regexp_extract({e}, '(\\d{{4}}-\\d{{2}}-\\d{{2}})', 1), ''), "
            f"CASE WHEN regexp_matches({e}, '^\\d{{8}}(T.*)?$') THEN "
            f"strftime(try_strptime(substr({e}, 1, 8), '%Y%m%d'), '%Y-%m-%d') END)")


def origin(expr: str) -> str:
    return f"regexp_extract({expr}, '^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)', 1)"


def first_email(expr: str) -> str:
    """Smallest recruiter address in an HTML text (NULL when none)."""
    from ..functions.text import ADDRESS_PATTERN, MAILTO_PATTERN, ROLE_ACCOUNT_PATTERN

    dom = "CASE WHEN contains(e, '@') THEN split_part(e, '@', 2) ELSE '' END"
    ok = (f"NOT regexp_matches(split_part(e, '@', 1), {lit(ROLE_ACCOUNT_PATTERN)}) "
          f"AND NOT {any_contains(dom, C.EMAIL_BLOCKED_DOMAIN_PARTS)} "
          f"AND length(split_part(e, '@', 1)) >= 3 AND contains({dom}, '.')")
    found = (f"list_transform(list_concat(regexp_extract_all(coalesce({expr}, ''), {lit(MAILTO_PATTERN)}, 1), "
             f"regexp_extract_all(coalesce({expr}, ''), {lit(ADDRESS_PATTERN)}, 1)), lambda x: lower(trim(x)))")
    return f"list_min(list_filter({found}, lambda e: {ok}))"


def initcap_slug(expr: str) -> str:
    return (f"array_to_string(list_transform(string_split(replace({expr}, '-', ' '), ' '), "
            f"lambda x: upper(substr(x, 1, 1)) || lower(substr(x, 2))), ' ')")
