"""Pattern files: configuration patterns, and the sources and sinks of dataflow; and the patterns that are used without a file."""

from __future__ import annotations

#: Name, kind, regex and the group that holds the key. They must match as given for equal results.
CONFIG_PATTERNS = [
    ("getenv", "ENV_VAR", r'getenv\s*\(\s*"([^"]+)"', 1),
    ("std::getenv", "ENV_VAR", r'std::getenv\s*\(\s*"([^"]+)"', 1),
    ("map_bracket", "CONFIG_MAP", r'(?:config|cfg|settings|options|params|conf)\s*\[\s*"([^"]+)"', 1),
    ("map_get", "CONFIG_MAP", r'(?:config|cfg|settings|options|params|conf)\.get\s*\(\s*"([^"]+)"', 1),
    ("map_at", "CONFIG_MAP", r'(?:config|cfg|settings|options|params|conf)\.at\s*\(\s*"([^"]+)"', 1),
    ("gflags_define_bool", "GFLAGS", r"DEFINE_bool\s*\(\s*(\w+)", 1),
    ("gflags_define_int", "GFLAGS", r"DEFINE_int(?:32|64)\s*\(\s*(\w+)", 1),
    ("gflags_define_string", "GFLAGS", r"DEFINE_string\s*\(\s*(\w+)", 1),
    ("gflags_usage", "GFLAGS", r"FLAGS_(\w+)", 1),
    ("boost_program_options", "CLI_ARG", r'vm\s*\[\s*"([^"]+)"', 1),
    ("boost_po_count", "CLI_ARG", r'vm\.count\s*\(\s*"([^"]+)"', 1),
    ("nlohmann_json", "JSON_CONFIG", r'(?:j|json|config_json|cfg_json)\s*(?:\[|\.at\s*\()\s*"([^"]+)"', 1),
    ("yaml_cpp", "YAML_CONFIG", r'(?:node|config|yaml)\s*\[\s*"([^"]+)"', 1),
    ("absl_flags", "CLI_ARG", r"absl::GetFlag\s*\(\s*FLAGS_(\w+)", 1),
    ("cli11_option", "CLI_ARG", r'add_(?:option|flag)\s*\(\s*"--?([^"]+)"', 1),
    ("define_macro", "PREPROCESSOR", r"^#define\s+((?:ENABLE_|DISABLE_|USE_|CONFIG_|FEATURE_)\w+)", 1),
    ("ifdef_config", "PREPROCESSOR", r"^#ifn?def\s+((?:ENABLE_|DISABLE_|USE_|CONFIG_|FEATURE_)\w+)", 1),
    ("keymatch", "CLI_ARG", r'keymatch\s*\(\s*\w+\s*,\s*"([^"]+)"', 1),
    ("getopt_long_option", "CLI_ARG", r'\{\s*"([^"]+)"\s*,\s*(no_argument|required_argument|optional_argument)', 1),
    ("getopt_short", "CLI_ARG", r"case\s+'(\w)'", 1),
    ("strcmp_argv", "CLI_ARG", r'strn?cmp\s*\(\s*argv\s*\[\s*\w+\s*\]\s*,\s*"--?([^"]+)"', 1),
    ("struct_ptr_assign", "STRUCT_FIELD", r"(\w+)->(\w+)\s*=\s*(.+?)\s*;", 2),
]


def builtin_patterns() -> list[dict]:
    return [{"name": n, "kind": k, "regex": r, "key_group": g} for n, k, r, g in CONFIG_PATTERNS]


def _read(path: str) -> dict:
    import yaml

    with open(path, encoding="utf-8") as f:
        found = yaml.safe_load(f)
    if not isinstance(found, dict):
        raise ValueError(f"{path} holds no mapping")
    return found


def config_patterns(path: str | None = None) -> list[dict]:
    """name, kind, regex, key_group and description of the patterns in a YAML file (patterns: a list), in order; those built in without one.

    An entry without a name or regex raises ValueError. Files are read on the driver; they are small by nature.
    """
    if path is None:
        return builtin_patterns()
    out = []
    for p in _read(path).get("patterns") or []:
        if not (isinstance(p, dict) and p.get("name") and p.get("regex")):
            raise ValueError(f"a pattern in {path} has no name or no regex")
        out.append({"name": p["name"], "kind": p.get("type", "OTHER"), "regex": p["regex"], "key_group": int(p.get("key_group", 1)), "description": p.get("description", "")})
    return out


def taint_patterns(path: str) -> tuple[list[str], list[dict]]:
    """Sources (regexes) and sinks (regex, value_arg where it is given) of a YAML file; ValueError where it has neither."""
    found = _read(path)
    sources = [p["regex"] for p in found.get("sources") or []]
    sinks = [{"regex": p["regex"]} | ({"value_arg": int(p["value_arg"])} if p.get("value_arg") is not None else {}) for p in found.get("sinks") or []]
    if not sources and not sinks:
        raise ValueError(f"{path} has neither sources nor sinks")
    return sources, sinks
