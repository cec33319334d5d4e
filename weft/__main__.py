"""python -m weft QUERY FOLDER: show what a registered query gives on a folder of tables; without QUERY list them."""

from __future__ import annotations

import sys


def main(args: list[str]) -> None:
    from weft.plans import catalogue, problems

    queries = catalogue.QUERIES | problems.QUERIES
    if len(args) < 2:
        print("\n".join(sorted(queries)))
        return
    from weft.session import local_session

    queries[args[0]](local_session("*"), args[1]).show(int(args[2]) if len(args) > 2 else 20, truncate=80)


if __name__ == "__main__":
    main(sys.argv[1:])
