"""Write COVERAGE.md: operator id -> registered queries (a star marks one without a SQL check)."""

import re

from jobtide.bindings import QUERIES


def key(op: str):
    letter, number = re.fullmatch(r"([A-Z])(\d+)", op).groups()
    return "SPJAWOUTMRC".index(letter), int(number)


def main() -> None:
    by_op: dict[str, list[str]] = {}
    for name, q in QUERIES.items():
        for op in q.covers:
            by_op.setdefault(op, []).append(f"`{name}`" + ("" if q.sql else " *"))
    checked = sum(q.sql is not None for q in QUERIES.values())
    lines = [
        "# Coverage", "",
        f"{len(QUERIES)} registered queries, {checked} with a SQL check, over {len(by_op)} operators. Written by `coverage.py`.", "",
        "| Operator | Queries |", "| --- | --- |",
        *[f"| {op} | {', '.join(by_op[op])} |" for op in sorted(by_op, key=key)],
    ]
    with open("COVERAGE.md", "w") as out:
        out.write("\n".join(lines) + "\n")


if __name__ == "__main__":
    main()
