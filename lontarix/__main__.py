"""``python -m lontarix list | sql NAME | run NAME --data DIR [--out PATH] [--rows N]``."""

from __future__ import annotations

import argparse

from . import queries
from .session import build


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="lontarix")
    p.add_argument("verb", choices=("list", "sql", "run"))
    p.add_argument("name", nargs="?")
    p.add_argument("--data", default="/root/testdata/sf0.001")
    p.add_argument("--out", help="write the result there as Parquet")
    p.add_argument("--rows", type=int, default=20, help="rows to show without --out")
    p.add_argument("--master", default="local[8]")
    a = p.parse_args(args)
    known = queries.queries()
    if a.verb == "list":
        print("\n".join(sorted(known)))
        return
    if a.name not in known:
        p.error(f"no query {a.name}")
    if a.verb == "sql":
        print(queries.oracles()[a.name])
        return
    df = known[a.name](build(a.master), a.data)
    if a.out:
        df.write.parquet(a.out)
    else:
        df.show(a.rows, truncate=60)


if __name__ == "__main__":
    main()
