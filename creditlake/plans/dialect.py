"""The few places where Spark SQL and DuckDB SQL differ, so that a plan and its oracle share one statement."""

from __future__ import annotations


class Spark:
    name = "spark"

    def days(self, a, b):
        return f"datediff({b}, {a})"

    def plus(self, d, n):
        return f"date_add({d}, cast({n} AS int))"

    def idiv(self, a, b):
        return f"({a} div {b})"

    def date(self, x):
        """Strict ISO date of a text, else null."""
        return f"(CASE WHEN {x} RLIKE '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$' THEN try_cast({x} AS date) END)"

    def number(self, x):
        """Plain decimal number of a text, else null."""
        return f"(CASE WHEN {x} RLIKE '^[+-]?[0-9]+([.][0-9]*)?$' THEN try_cast({x} AS double) END)"

    def matches(self, x, pattern):
        return f"({x} RLIKE '^{pattern}$')"

    def iso(self, d):
        return f"date_format({d}, 'yyyy-MM-dd')"

    def plain(self, x):
        """Upper case without accents, for the letters that the projection uses."""
        return f"upper(translate({x}, 'éèêëàâïîôöûüçÉÈ', 'eeeeaaiioouucEE'))"

    def replace_all(self, x, pattern, by):
        return f"regexp_replace({x}, '{pattern}', '{by}')"

    def quantile(self, x, q):
        return f"percentile({x}, {q}D)"

    def half_even(self, x):
        return f"cast(rint({x}) AS bigint)"

    def findings(self, source, keys, checks):
        """One row for each rule (code: predicate, field) that a record breaks, in one narrow pass over the records."""
        each = ", ".join(f"CASE WHEN {rule} THEN named_struct('code', '{c}', 'champ', {field}) END" for c, (rule, field) in checks.items())
        return f"SELECT {keys}, r.code, r.champ FROM {source} LATERAL VIEW inline(filter(array({each}), x -> x IS NOT NULL)) r AS code, champ"

    def lcs_similarity(self, a, b):
        """Normalised Indel similarity, 0 to 100: 200 * LCS / (length a + length b), by rows of the LCS table."""
        row0 = f"transform(sequence(0, length({b})), x -> 0)"
        cell = f"greatest(out[j], CASE WHEN substr({a}, i, 1) = substr({b}, j + 1, 1) THEN acc[j] + 1 ELSE acc[j + 1] END)"
        step = f"aggregate(sequence(0, length({b}) - 1), array(0), (out, j) -> concat(out, array({cell})))"
        return f"(CASE WHEN length({a}) = 0 OR length({b}) = 0 THEN 0D ELSE 200D * element_at(aggregate(sequence(1, length({a})), {row0}, (acc, i) -> {step}), -1) / (length({a}) + length({b})) END)"


class DuckDB(Spark):
    name = "duckdb"

    def days(self, a, b):
        return f"date_diff('day', {a}, {b})"

    def plus(self, d, n):
        return f"cast({d} + cast({n} AS integer) AS date)"

    def idiv(self, a, b):
        return f"({a} // {b})"

    def date(self, x):
        return f"(CASE WHEN regexp_full_match({x}, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') THEN try_cast({x} AS date) END)"

    def number(self, x):
        return f"(CASE WHEN regexp_full_match({x}, '[+-]?[0-9]+([.][0-9]*)?') THEN try_cast({x} AS double) END)"

    def matches(self, x, pattern):
        return f"regexp_full_match({x}, '{pattern}')"

    def iso(self, d):
        return f"strftime({d}, '%Y-%m-%d')"

    def plain(self, x):
        return f"upper(strip_accents({x}))"

    def replace_all(self, x, pattern, by):
        return f"regexp_replace({x}, '{pattern}', '{by}', 'g')"

    def quantile(self, x, q):
        return f"quantile_cont({x}, {q})"

    def half_even(self, x):
        return f"cast(round_even({x}, 0) AS bigint)"

    def findings(self, source, keys, checks):
        return " UNION ALL ".join(f"SELECT {keys}, '{c}' AS code, {field} AS champ FROM {source} WHERE {rule}" for c, (rule, field) in checks.items())
