"""Type -> parser. Further languages are registered here and travel with the job."""

from __future__ import annotations

from collections.abc import Callable

from codestrata.parsers import braces, markup, script, sql, words

PARSERS: dict[str, Callable[[str], dict]] = {
    "markup": markup.parse_html, "stylesheet": markup.parse_css, "javascript": script.parse_javascript, "typescript": script.parse_javascript, "python": script.parse_python,
    "php": braces.parse_php, "csharp": braces.parse_csharp, "java": braces.parse_java, "go": braces.parse_go, "rust": braces.parse_rust, "c": braces.parse_c, "cpp": braces.parse_c,
    "ruby": words.parse_ruby, "powershell": words.parse_powershell, "ini": words.parse_ini, "sln": markup.parse_sln, "csproj": markup.parse_csproj, "config": markup.parse_config,
    "xaml": markup.parse_xaml, "cargotoml": markup.parse_cargo_toml, "cargolock": markup.parse_cargo_lock, "rusttoolchain": markup.parse_toolchain, "cargoconfig": markup.parse_cargo_config, "sql": sql.parse_sql,
}


def register_parser(kind: str, parser: Callable[[str], dict]) -> None:
    PARSERS[kind] = parser


def parse_source(kind: str, content: str) -> dict:
    """Facts of one text; an unknown type has none. Raises on a text its parser rejects."""
    parser = PARSERS.get(kind)
    return parser(content) if parser else {}
