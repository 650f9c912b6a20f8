"""python -m terrane.cli.diff --tables LEFT RIGHT: compare two tables and write a report."""

from __future__ import annotations

import argparse
import sys

from terrane.diff import DiffFormatOptions, compare_dataframes
from terrane.session import build_session
from terrane.sources.session import Session


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="terrane-diff", description="Compare two tables and write an HTML report.")
    out.add_argument("--tables", nargs=2, metavar=("LEFT_TABLE", "RIGHT_TABLE"), required=True, help="catalogue names, or paths of Parquet files")
    out.add_argument("--join-cols", nargs="*", default=None, help="fields that tell rows apart, also inside arrays; found if absent")
    out.add_argument("--output", default="diff_report.html", help="path of the report")
    out.add_argument("--nb-top-values", type=int, default=10, help="values shown for each column and state (default: 10)")
    return out


def main(argv: list[str] | None = None) -> None:
    argv = sys.argv[1:] if argv is None else argv
    args = parser().parse_args(argv or ["--help"])
    session = Session(build_session())
    left, right = (session.table(t) for t in args.tables)
    result = compare_dataframes(left, right, args.join_cols)
    result.export_to_html(output_file_path=args.output, diff_format_options=DiffFormatOptions(nb_diffed_rows=args.nb_top_values))


if __name__ == "__main__":
    main()
