"""Pieces of DuckDB SQL that the oracles share; written apart from the Spark expressions."""

WS = r"[\s\p{Z}\x0b\x1c-\x1f\x85]"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def norm_section(x: str) -> str:
    return strip(f"regexp_replace(replace(lower({x}), '§', ''), '{WS}+', ' ', 'g')")


def section_set(x: str) -> str:
    kept = f"list_filter(coalesce({x}, []::VARCHAR[]), lambda z: coalesce({strip('z')} <> '', false))"
    return f"list_sort(list_distinct(list_transform({kept}, lambda z: {norm_section('z')})))"


def tokens(x: str) -> str:
    return f"regexp_extract_all(lower(coalesce({x}, '')), '[0-9A-Za-zÆØÅæøå]+')"


def chapter(x: str) -> str:
    bare = strip(f"replace(coalesce({x}, ''), '§', '')")
    return f"CASE WHEN contains({bare}, '-') THEN split_part({bare}, '-', 1) END"


def chapters(x: str) -> str:
    return f"list_sort(list_distinct(list_filter(list_transform(coalesce({x}, []::VARCHAR[]), lambda z: {chapter('z')}), lambda z: z IS NOT NULL)))"


def clean(x: str) -> str:
    lines = f"list_filter(list_transform(regexp_split_to_array(coalesce({x}, ''), '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x85\\x{{2028}}\\x{{2029}}]'), lambda z: {strip('z')}), lambda z: z <> '')"
    return f"(SELECT coalesce(array_to_string(list_filter(l, lambda z, i: i = 1 OR z <> l[i - 1]), chr(10)), '') FROM (SELECT {lines} AS l))"


def content_words(x: str, stop: list[str]) -> str:
    words = ", ".join(f"'{w}'" for w in stop)
    return f"list_filter(list_distinct(regexp_extract_all(lower(coalesce({x}, '')), '[0-9a-zæøå]{{4,}}')), lambda z: NOT list_contains([{words}], z))"


def div(a: str, b: str) -> str:
    return f"coalesce(({a})::DOUBLE / nullif(({b})::DOUBLE, 0), 0)"


def metrics(tp: str = "tp", fp: str = "fp", tn: str = "tn", fn: str = "fn") -> dict[str, str]:
    total = f"({tp} + {fp} + {tn} + {fn})"
    p, r, s = div(tp, f"{tp} + {fp}"), div(tp, f"{tp} + {fn}"), div(tn, f"{tn} + {fp}")
    root = f"sqrt(({tp} + {fp})::DOUBLE * ({tp} + {fn}) * ({tn} + {fp}) * ({tn} + {fn}))"
    return {
        "accuracy": div(f"{tp} + {tn}", total), "precision": p, "recall": r, "specificity": s, "f1": div(f"2 * {p} * {r}", f"{p} + {r}"),
        "balanced_accuracy": f"0.5 * ({r} + {s})", "mcc": div(f"{tp}::DOUBLE * {tn} - {fp}::DOUBLE * {fn}", root),
        "refusal_rate_pred": div(f"{tp} + {fp}", total), "refusal_rate_true": div(f"{tp} + {fn}", total),
    }


def wilson(k: str, n: str) -> tuple[str, str]:
    p, z2 = f"({k})::DOUBLE / ({n})", 1.96 * 1.96
    centre, half = f"({p} + {z2} / (2 * ({n})))", f"1.96 * sqrt({p} * (1 - {p}) / ({n}) + {z2} / (4.0 * ({n}) * ({n})))"
    scale = f"(1 + {z2} / ({n}))"
    return tuple(f"CASE WHEN ({n}) > 0 THEN {g}({e}, ({centre} {o} {half}) / {scale}) ELSE 0 END" for g, e, o in (("greatest", "0", "-"), ("least", "1", "+")))
