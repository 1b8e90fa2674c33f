"""One explicit options object; every limit and list an operator uses comes from here."""

from __future__ import annotations

from dataclasses import dataclass, field
from decimal import Decimal

from corpusmill import fixed_values as fv
from corpusmill.functions.tokens import TokenMeasure, word_symbol_measure


@dataclass(frozen=True)
class Options:
    discovered_suffixes: tuple[str, ...] = fv.DISCOVERED_SUFFIXES
    skip_dirs: tuple[str, ...] = fv.SKIP_DIRS
    min_file_bytes: int = 1
    # None: no file is too large.
    max_file_bytes: int | None = None

    source_extensions: tuple[str, ...] = fv.SOURCE_EXTENSIONS
    source_languages: tuple[str, ...] = fv.SOURCE_LANGUAGES
    config_extensions: tuple[str, ...] = fv.CONFIG_EXTENSIONS
    skip_extensions: tuple[str, ...] = fv.SKIP_EXTENSIONS
    skip_filenames: tuple[str, ...] = fv.SKIP_FILENAMES
    generated_markers: tuple[str, ...] = fv.GENERATED_MARKERS
    generated_head_lines: int = fv.GENERATED_HEAD_LINES
    minified_below_lines: int = fv.MINIFIED_BELOW_LINES
    minified_above_bytes: int = fv.MINIFIED_ABOVE_BYTES
    binary_sample_chars: int = fv.BINARY_SAMPLE_CHARS
    binary_threshold: float = fv.BINARY_THRESHOLD

    measure: TokenMeasure = field(default_factory=word_symbol_measure)
    max_tokens: int = fv.MAX_CHUNK_TOKENS
    header_min_tokens: int = fv.HEADER_MIN_TOKENS
    # Range blocks for operators that walk a total order; None leaves the number to Spark.
    blocks: int | None = None

    input_cost_per_1k: Decimal = Decimal(fv.INPUT_COST_PER_1K)
    output_cost_per_1k: Decimal = Decimal(fv.OUTPUT_COST_PER_1K)
    # None: every request is admitted.
    max_cost: Decimal | None = None
    context_chars: int = fv.CONTEXT_CHARS
