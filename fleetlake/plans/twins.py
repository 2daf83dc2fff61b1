"""SQL texts of functions the twin engine lacks."""

from __future__ import annotations


def size_sql(n: str) -> str:
    """Bytes as text, by its own rule: halves rounded up, next unit from 10240 on."""
    def unit(power: int) -> str:
        return f"CAST(floor((floor(abs({n}) / {2 ** (10 * power - 1)}) + 1) / 2) AS BIGINT)"

    sign = f"CASE WHEN {n} < 0 THEN '-' ELSE '' END"
    return (
        f"CASE WHEN abs({n}) < 10240 THEN concat(CAST({n} AS STRING), ' bytes') "
        f"WHEN {unit(1)} < 10240 THEN concat({sign}, CAST({unit(1)} AS STRING), ' kB') "
        f"WHEN {unit(2)} < 10240 THEN concat({sign}, CAST({unit(2)} AS STRING), ' MB') "
        f"WHEN {unit(3)} < 10240 THEN concat({sign}, CAST({unit(3)} AS STRING), ' GB') "
        f"WHEN {n} IS NOT NULL THEN concat({sign}, CAST({unit(4)} AS STRING), ' TB') END"
    )


def hex_sql(text: str) -> str:
    """A hexadecimal text as a HUGEINT."""
    return f"CAST(concat('0x', {text}) AS HUGEINT)"


def lsn_sql(position: str) -> str:
    return f"({hex_sql(f'split_part({position}, chr(47), 1)')} * 4294967296 + {hex_sql(f'split_part({position}, chr(47), 2)')})"
