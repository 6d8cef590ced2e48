"""All options of a run, with their defaults and the rules between them."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from strandflow.operators.demux import Barcode


class ConfigError(ValueError):
    pass


@dataclass(frozen=True)
class Config:
    paired: bool = False
    head: int | None = None
    quality_format: str = "33"
    mate_separator: str | None = None
    normalize_mate_separator: str | None = None
    mask_degenerate_bases: bool = False
    convert_uracils: bool = False

    adapters: tuple[tuple[str, str], ...] = ()
    adapter_selection: str | None = None
    adapter_fallback: str = "undefined"

    min_overlap: int | None = None
    mismatch_rate: float = 0.1667
    shift: int = 2
    merge: bool = False
    merge_threshold: int = 11
    merge_strategy: str = "maximum"
    merge_quality_max: int = 41
    prefix_read1: str = ""
    prefix_read2: str = ""
    prefix_merged: str = ""

    pre_trim3p: tuple[int, int] = (0, 0)
    post_trim5p: tuple[int, int] = (0, 0)
    post_trim3p: tuple[int, int] = (0, 0)
    quality_trimming: str = "mott"
    trim_mott_rate: float = 0.05
    trim_windows: float = 0.1
    trim_min_quality: int = 2
    pre_trim_polyx: str = "auto"
    post_trim_polyx: str = ""
    trim_polyx_threshold: int = 10
    preserve5p: bool = False

    max_ns: int | None = None
    max_ns_fraction: float | None = None
    min_length: int = 15
    max_length: int | None = None
    min_mean_quality: float = 0.0
    min_complexity: float = 0.0

    barcodes: tuple[Barcode, ...] = ()
    multiple_barcodes: bool = False
    barcode_orientation: str = "unspecified"
    normalize_orientation: bool = False
    barcode_mm: int = 0
    barcode_mm_r1: int | None = None
    barcode_mm_r2: int | None = None
    demultiplex_only: bool = False

    report_only: bool = False
    report_sample_rate: float = 0.1
    report_duplication: int | None = None
    report_title: str = ""
    out_prefix: str = ""
    out_format: str = "fastq.gz"
    read_group: dict[str, str] = field(default_factory=dict)

    def resolved(self) -> Config:
        """The same options with what depends on others filled in; raises ConfigError where they contradict."""
        out = self
        if out.mismatch_rate < 0:
            raise ConfigError("mismatch rate below 0")
        if out.mismatch_rate > 1:
            # One mismatch in so many bases.
            out = replace(out, mismatch_rate=1 / out.mismatch_rate)
        if out.min_overlap is None:
            out = replace(out, min_overlap=out.merge_threshold if out.paired else 1)
        if out.min_overlap < 1 or out.merge_threshold < 1:
            raise ConfigError("overlaps of at least one base are needed")
        selection = out.adapter_selection or ("manual" if out.adapters else "auto")
        if out.report_only:
            selection = "auto"
        if selection == "manual" and not out.adapters:
            raise ConfigError("manual adapter selection needs adapters")
        if selection in ("auto", "none", "undefined") and out.adapters:
            raise ConfigError(f"adapters are given, but their selection is {selection}")
        if selection == "undefined" and not out.paired:
            raise ConfigError("single reads can't be trimmed without known adapters")
        if selection not in ("auto", "manual", "none", "undefined"):
            raise ConfigError(f"unknown adapter selection {selection!r}")
        if out.adapter_fallback not in ("abort", "undefined", "none"):
            raise ConfigError(f"unknown adapter fallback {out.adapter_fallback!r}")
        fallback = "none" if out.report_only or (out.adapter_fallback == "undefined" and not out.paired) else out.adapter_fallback
        out = replace(out, adapter_selection=selection, adapter_fallback=fallback)
        if out.merge and not out.paired:
            raise ConfigError("only mates can be merged")
        if out.merge_strategy not in ("maximum", "additive"):
            raise ConfigError(f"unknown merge strategy {out.merge_strategy!r}")
        if out.quality_trimming not in ("none", "mott", "window", "per-base"):
            raise ConfigError(f"unknown quality trimming {out.quality_trimming!r}")
        if out.max_length is not None and out.max_length < out.min_length:
            raise ConfigError("maximum length below minimum length")
        if out.max_ns_fraction is not None and not 0 <= out.max_ns_fraction <= 1:
            raise ConfigError("the share of Ns is between 0 and 1")
        if not 0 <= out.report_sample_rate <= 1:
            raise ConfigError("the sample rate is between 0 and 1")
        if out.demultiplex_only and not out.barcodes:
            raise ConfigError("demultiplexing needs barcodes")
        if out.normalize_orientation and out.barcode_orientation == "unspecified":
            raise ConfigError("orientation can't be normalized without orientations of barcodes")
        for name, others in (("mate_separator", ()), ("normalize_mate_separator", ("strip",))):
            value = getattr(out, name)
            if value is not None and len(value) != 1 and value not in others and not (name == "mate_separator" and value == ""):
                raise ConfigError(f"{name} is one character, not {value!r}")
        for name in ("pre_trim_polyx", "post_trim_polyx"):
            value = getattr(out, name)
            if value != "auto" and set(value.upper()) - set("ACGT"):
                raise ConfigError(f"unknown bases {value!r}")
        if set(out.read_group) - {"ID", "BC", "CN", "DS", "DT", "FO", "KS", "LB", "PG", "PI", "PL", "PM", "PU", "SM"}:
            raise ConfigError("unknown fields of a read group")
        return out
