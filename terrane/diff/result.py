"""What a diff found: counts, values by column, and reports."""

from __future__ import annotations

import functools
import html
import json
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrane.diff.schema_diff import SchemaDiffResult
from terrane.operators.analyze import as_text
from terrane.operators.frame import table_text
from terrane.operators.transformations import union_dataframes
from terrane.plans import paths as P

EXISTS, IS_EQUAL = "__EXISTS__", "__IS_EQUAL__"



class Predicates:
    """Conditions on the rows of a diff; functions, as columns need a running session."""

    @staticmethod
    def in_left() -> Column:
        return F.col(EXISTS)["left_value"]

    @staticmethod
    def in_right() -> Column:
        return F.col(EXISTS)["right_value"]

    @classmethod
    def present_in_both(cls) -> Column:
        return cls.in_left() & cls.in_right()

    @classmethod
    def only_in_left(cls) -> Column:
        return cls.in_left() & ~cls.in_right()

    @classmethod
    def only_in_right(cls) -> Column:
        return ~cls.in_left() & cls.in_right()

    @staticmethod
    def row_is_equal() -> Column:
        return F.col(IS_EQUAL)

    @classmethod
    def row_changed(cls) -> Column:
        return cls.present_in_both() & ~F.col(IS_EQUAL)


@dataclass(frozen=True)
class DiffFormatOptions:
    nb_diffed_rows: int = 10
    max_string_length: int = 30
    left_df_alias: str = "left"
    right_df_alias: str = "right"


@dataclass(frozen=True)
class DiffStats:
    """Rows of one granularity."""

    total: int
    no_change: int
    changed: int
    in_left: int
    in_right: int
    only_in_left: int
    only_in_right: int

    @property
    def same_data(self) -> bool:
        return self.no_change == self.total

    def percent(self, part: str) -> float:
        """Share of a count in all rows; nothing in nothing is 0."""
        return round(100 * getattr(self, part) / self.total, 2) if self.total else 0.0

    percent_changed = property(lambda self: self.percent("changed"))
    percent_no_change = property(lambda self: self.percent("no_change"))
    percent_only_in_left = property(lambda self: self.percent("only_in_left"))
    percent_only_in_right = property(lambda self: self.percent("only_in_right"))

    def text(self, left: str = "left", right: str = "right") -> str:
        if self.in_left == self.in_right:
            lines = [f"Row count ok: {self.in_left} rows"]
        else:
            more = abs(self.in_right - self.in_left)
            lines = ["Row count changed:", f"nb_rows {left}: {self.in_left}", f"nb_rows {right}: {self.in_right}", f"difference: {more} rows"]
        parts = [(self.no_change, self.percent_no_change, "are identical"), (self.changed, self.percent_changed, "have changed")]
        parts += [(self.only_in_left, self.percent_only_in_left, f"are only in '{left}'"), (self.only_in_right, self.percent_only_in_right, f"are only in '{right}'")]
        return "\n".join([*lines, "", *[f"{n} ({p}%) rows {what}" for n, p, what in parts], ""])


STATES = ("changed", "no_change", "only_in_left", "only_in_right")


class DiffResult:
    """Everything is computed when it is asked for, once; counts of rows take one pass, and what takes more caches the diff frames."""

    def __init__(self, schema_diff: SchemaDiffResult, shards: dict[str, DataFrame], join_cols: list[str]):
        self.schema_diff_result, self.join_cols = schema_diff, join_cols
        self.diff_df_shards = dict(shards)

    def keep(self) -> None:
        """From now on the diff frames are cached."""
        for df in self.diff_df_shards.values():
            if not df.is_cached:
                df.persist()

    def close(self) -> None:
        for df in self.diff_df_shards.values():
            if df.is_cached:
                df.unpersist()

    @property
    def same_schema(self) -> bool:
        return self.schema_diff_result.same_schema

    @functools.cached_property
    def diff_stats_shards(self) -> dict[str, DiffStats]:
        return {k: self._stats(df) for k, df in self.diff_df_shards.items()}

    @staticmethod
    def _stats(df: DataFrame) -> DiffStats:
        p = Predicates
        row = df.agg(
            F.count(F.lit(1)), F.count_if(p.row_is_equal()), F.count_if(p.row_changed()), F.count_if(p.in_left()), F.count_if(p.in_right()), F.count_if(p.only_in_left()), F.count_if(p.only_in_right())
        ).first()
        return DiffStats(*row)

    @property
    def same_data(self) -> bool:
        return all(s.same_data for s in self.diff_stats_shards.values())

    @property
    def is_ok(self) -> bool:
        return self.same_schema and self.same_data

    @functools.cached_property
    def total_nb_rows(self) -> int:
        """Rows of the root granularity, or of the first one."""
        return next(iter(self.diff_stats_shards.values())).total if self.diff_stats_shards else 0

    def _long(self, level: str, df: DataFrame) -> DataFrame:
        """A row for each row and column that has a value on a side: column, state, both values as text."""
        names = [c for c in df.columns if c not in (EXISTS, IS_EQUAL) and P.granularity(P.unmangle(c)) == level]
        cells = []
        for c in names:
            kind = df.schema[c].dataType["left_value"].dataType
            other = df.schema[c].dataType["right_value"].dataType
            v = F.col(f"`{c}`")
            state = F.when(v["is_equal"], "no_change").when(v["exists_left"] & v["exists_right"], "changed").when(v["exists_left"], "only_in_left").when(v["exists_right"], "only_in_right")
            cells.append(F.struct(F.lit(P.unmangle(c)).alias("column_name"), state.alias("state"), as_text(v["left_value"], kind).alias("left_value"), as_text(v["right_value"], other).alias("right_value")))
        return df.select(F.inline(F.array(*cells))).filter("state IS NOT NULL")

    @functools.cached_property
    def top_per_col_state_df(self) -> DataFrame:
        """Counts of equal (column, state, values), ranked within column and state."""
        self.keep()
        parts = [self._long(k, df) for k, df in self.diff_df_shards.items() if any(P.granularity(P.unmangle(c)) == k for c in df.columns)]
        counts = union_dataframes(parts).groupBy("column_name", "state", "left_value", "right_value").agg(F.count(F.lit(1)).alias("nb"))
        rank = Window.partitionBy("column_name", "state").orderBy(F.desc("nb"), "left_value", "right_value")
        return counts.withColumn("row_num", F.row_number().over(rank))

    @functools.cache  # noqa: B019
    def get_diff_per_col_df(self, max_nb_rows_per_col_state: int = 10) -> DataFrame:
        """For each column its counts by state and the most frequent values of each state."""
        top = self.top_per_col_state_df
        names = self.schema_diff_result.column_names
        columns = top.sparkSession.createDataFrame(list(enumerate(names)), "column_number int, column_name string")
        value = {
            "changed": F.struct("left_value", "right_value", "nb"), "no_change": F.struct(F.col("left_value").alias("value"), "nb"),
            "only_in_left": F.struct(F.col("left_value").alias("value"), "nb"), "only_in_right": F.struct(F.col("right_value").alias("value"), "nb"),
        }
        counts = top.groupBy("column_name").agg(F.sum("nb").alias("total"), *[F.coalesce(F.sum(F.when(F.col("state") == s, F.col("nb"))), F.lit(0)).alias(s) for s in STATES])
        # The rank bounds what is gathered; Spark applies it before the shuffle.
        best = top.filter(F.col("row_num") <= max_nb_rows_per_col_state).groupBy("column_name")
        lists = best.agg(*[F.array_sort(F.collect_list(F.when(F.col("state") == s, value[s]))).alias(f"d_{s}") for s in STATES])
        out = columns.join(counts, "column_name", "left").join(lists, "column_name", "left")
        zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c)
        empty = {s: F.coalesce(F.col(f"d_{s}"), F.array().cast(lists.schema[f"d_{s}"].dataType)).alias(s) for s in STATES}
        order = F.struct(*[zero(c) for c in ("total", *STATES)]).alias("counts")
        return out.select("column_number", "column_name", order, F.struct(*empty.values()).alias("diff")).orderBy("column_number")

    # Reports.

    def _rows(self, options: DiffFormatOptions) -> list:
        return self.get_diff_per_col_df(options.nb_diffed_rows).collect()

    def _text(self, show_examples: bool, options: DiffFormatOptions) -> str:
        left, right = options.left_df_alias, options.right_df_alias
        self.keep()
        out = [self.schema_diff_result.text()]
        stats = self.diff_stats_shards
        if self.is_ok or (self.same_data and self.same_schema):
            return "\n".join([*out, f"\ndiff ok! ({self.total_nb_rows} rows)\n"])
        out.append("\ndiff NOT ok\n")
        if len(stats) > 1:
            out.append("WARNING: This diff has several granularity levels; the HTML report is easier to read.\n")
        rows = self._rows(options)
        for level, s in stats.items():
            here = [r for r in rows if P.granularity(r.column_name) == level]
            if len(stats) > 1:
                out += ["#" * 62, f"Granularity : {level or 'root'} ({s.total} rows)\n"]
            out.append(s.text(left, right))
            if s.changed:
                changes = [(r.column_name, r.counts.changed, d.left_value, d.right_value, d.nb) for r in here for d in sorted(r.diff.changed, key=lambda d: -d.nb)]
                out += ["Changed values:", table_text(["column_name", "total_nb_diff", "left_value", "right_value", "nb_differences"], _cut(changes, options))]
                if show_examples:
                    out += self._examples(level, here, options)
            for side, name in (("left", left), ("right", right)):
                n = getattr(s, f"only_in_{side}")
                if n:
                    values = [(r.column_name, d.value, d.nb) for r in here for d in sorted(r.diff[f"only_in_{side}"], key=lambda d: -d.nb)]
                    out += [f"{n} rows are in '{name}' alone:", f"Values that '{name}' has most often there, by column:", table_text(["column_name", "value", "nb"], _cut(values, options))]
        return "\n".join(out)

    def _examples(self, level: str, rows: list, options: DiffFormatOptions) -> list[str]:
        df = self.diff_df_shards[level]
        keys = [P.mangle(k) for k in self.join_cols if P.mangle(k) in df.columns]
        out = ["Examples by column:"]
        for r in rows:
            c = P.mangle(r.column_name)
            if r.counts.changed and c not in keys:
                v = F.col(f"`{c}`")
                shown = [F.coalesce(F.col(f"`{k}`")["left_value"], F.col(f"`{k}`")["right_value"]).cast("string").alias(P.unmangle(k)) for k in keys]
                kind = df.schema[c].dataType["left_value"].dataType
                some = df.filter(v["exists_left"] & v["exists_right"] & ~v["is_equal"]).select(*shown, as_text(v["left_value"], kind).alias("l"), as_text(v["right_value"], kind).alias("r"))
                found = [tuple(x) for x in some.orderBy(*[F.col(f"`{P.unmangle(k)}`") for k in keys]).limit(options.nb_diffed_rows).collect()]
                names = [P.unmangle(k) for k in keys] + [f"{r.column_name} ({options.left_df_alias})", f"{r.column_name} ({options.right_df_alias})"]
                out += [f"'{r.column_name}' : {r.counts.changed} rows", table_text(names, _cut(found, options))]
        return out

    def display(self, show_examples: bool = False, diff_format_options: DiffFormatOptions = DiffFormatOptions()) -> None:  # noqa: B008
        print(self._text(show_examples, diff_format_options))

    def summary(self, options: DiffFormatOptions = DiffFormatOptions()) -> dict:  # noqa: B008
        """Everything a report shows, as plain values."""
        self.keep()
        return {
            "same_schema": self.same_schema, "schema_diff": self.schema_diff_result.diff_str, "column_names_diff": self.schema_diff_result.column_names_diff, "same_data": self.same_data,
            "total_nb_rows": self.total_nb_rows, "join_cols": self.join_cols, "left": options.left_df_alias, "right": options.right_df_alias,
            "stats": {k or "root": asdict(s) for k, s in self.diff_stats_shards.items()}, "columns": [r.asDict(recursive=True) for r in self._rows(options)],
        }

    def export_to_html(
        self, title: str = "Data diff", output_file_path: str = "diff_report.html", encoding: str = "utf8", diff_format_options: DiffFormatOptions = DiffFormatOptions()  # noqa: B008
    ) -> None:
        """One file that needs nothing else: tables, and the numbers behind them as JSON."""
        with open(output_file_path, "w", encoding=encoding) as f:
            f.write(html_report(self.summary(diff_format_options), title))
        print(f"Report exported as {output_file_path}")


def _cut(rows: list[tuple], options: DiffFormatOptions) -> list[tuple]:
    most = options.max_string_length
    return [tuple(v[: most - 3] + "..." if isinstance(v, str) and i and len(v) > most else v for i, v in enumerate(r)) for r in rows]


def html_report(summary: dict, title: str) -> str:
    esc = lambda v: html.escape("" if v is None else str(v))

    def table(head: list[str], rows: list[list]) -> str:
        body = "".join("<tr>" + "".join(f"<td>{esc(c)}</td>" for c in r) + "</tr>" for r in rows)
        return "<table><thead><tr>" + "".join(f"<th>{esc(h)}</th>" for h in head) + f"</tr></thead><tbody>{body}</tbody></table>"

    stats = table(["granularity", *next(iter(summary["stats"].values()), {})], [[k, *s.values()] for k, s in summary["stats"].items()])
    parts = []
    for c in summary["columns"]:
        lists = []
        for state in STATES:
            found = sorted(c["diff"][state], key=lambda d: -d["nb"])
            if found:
                lists.append(f"<h4>{state}</h4>" + table(list(found[0]), [list(d.values()) for d in found]))
        counts = ", ".join(f"{k} {v}" for k, v in c["counts"].items())
        parts.append(f"<details><summary>{esc(c['column_name'])}: {esc(counts)}</summary>{''.join(lists)}</details>")
    data = json.dumps(summary, default=str).replace("</", "<\\/")
    style = "body{font-family:sans-serif;margin:2em}table{border-collapse:collapse}td,th{border:1px solid #ccc;padding:.2em .6em;text-align:left}pre{background:#f4f4f4;padding:1em}"
    verdict = "Schemas and data are the same." if summary["same_schema"] and summary["same_data"] else "The tables differ."
    schema = f"<h2>Schema</h2><pre>{esc(summary['schema_diff'] or 'unchanged')}</pre>"
    return (
        f'<!DOCTYPE html><html><head><meta charset="utf-8"><title>{esc(title)}</title><style>{style}</style></head><body><h1>{esc(title)}</h1><p>{verdict}</p>{schema}'
        f'<h2>Rows</h2>{stats}<h2>Columns</h2>{"".join(parts)}<script type="application/json" id="diff">{data}</script></body></html>'
    )


def stringify_col(col: Column, kind: T.DataType) -> Column:
    """A value as the text that reports show."""
    return as_text(col, kind)
