"""Settings of the compression pipeline and their presets."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace


@dataclass(frozen=True)
class Config:
    hygiene: bool = True
    serialize: bool = True
    dedup: bool = True
    serialize_min_rows: int = 2
    serialize_nested: bool = True
    serialize_csv: bool = True
    serialize_flatten: bool = False
    serialize_buckets: bool = False
    dedup_near: bool = False
    dedup_distance: int = 3
    toolout: bool = False
    toolout_min_lines: int = 20
    toolout_max_lines: int = 40
    json_crush: bool = False
    json_crush_rows: int = 50
    strip_base64: bool = False
    numeric_digits: int = 0
    normalize_unicode: bool = False
    retrieve: bool = False
    retrieve_sentence: bool = False
    retrieve_ratio: float = 0.5
    retrieve_min_chars: int = 600
    skeleton: bool = False
    skeleton_full: int = 5
    skeleton_drop: bool = False
    minify_code: bool = False
    ngram: bool = False
    ngram_entries: int = 32
    tool_select: bool = False
    tool_trim: bool = False
    tool_minify: bool = False
    tool_chars: int = 300
    image: bool = False
    image_detail: str = ""
    output: bool = False
    output_level: str = "terse"
    output_frugal: bool = False
    output_direct: bool = False
    output_budget: int = 0
    output_max_tokens: int = 0
    cache: bool = False
    cache_marks: int = 4
    auto: bool = False


_SHAPED = dict(toolout=True, json_crush=True, output=True, image=True, strip_base64=True, output_direct=True)
_TOOLS = dict(tool_select=True, tool_trim=True, tool_minify=True, cache=True, serialize_flatten=True, serialize_buckets=True)
PRESETS = {
    "safe": Config(),
    "lossless": Config(),
    "auto": Config(auto=True),
    "frugal": Config(output_frugal=True),
    "rag": Config(retrieve=True, retrieve_sentence=True, retrieve_ratio=0.35, **_SHAPED),
    "agent": Config(output_frugal=True, **_TOOLS, **_SHAPED),
    "code": Config(skeleton=True, minify_code=True, **_SHAPED),
    "aggressive": Config(
        retrieve=True, retrieve_sentence=True, retrieve_ratio=0.35, skeleton=True, skeleton_drop=True, minify_code=True,
        dedup_near=True, ngram=True, normalize_unicode=True, **_TOOLS, **_SHAPED,
    ),
    "cache": Config(cache=True),
    "reasoning": Config(output=True, output_level="draft"),
}


def preset(name: str) -> Config:
    """A preset by name; unknown names raise."""
    return PRESETS[name.lower()]


def from_table(table: dict) -> Config:
    """A configuration from parsed TOML: a `preset` key wins over all others; unknown keys raise."""
    if "preset" in table:
        return preset(table["preset"])
    unknown = set(table) - {f.name for f in fields(Config)}
    if unknown:
        raise ValueError(f"unknown settings: {sorted(unknown)}")
    return replace(Config(), **table)


def ablations(config: Config) -> dict[str, Config]:
    """The configuration with one enabled stage off at a time."""
    stages = ("hygiene", "serialize", "dedup", "toolout", "json_crush", "retrieve", "skeleton", "minify_code", "ngram", "tool_select", "output", "cache")
    return {"all": config} | {f"no_{s}": replace(config, **{s: False}) for s in stages if getattr(config, s)}
