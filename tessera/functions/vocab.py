"""Fixed vocabularies of the graph: their spelling and order are part of the data format."""

from __future__ import annotations

# Entity kinds, in the order that ranks them.
ENTITY_KINDS = (
    "repository", "workspace", "package", "module", "file", "function", "method", "constructor", "class", "struct", "union", "enum",
    "interface", "trait", "protocol", "type_alias", "type_parameter", "variable", "constant", "static", "field", "property", "parameter", "macro",
)
KIND_ORD = {k: i for i, k in enumerate(ENTITY_KINDS)}
TYPE_KINDS = ("class", "struct", "union", "enum", "interface", "trait", "protocol", "type_alias")
CALLABLE_KINDS = ("function", "method", "constructor")
MEMBER_KINDS = ("method", "constructor", "field", "property")
CONTAINER_KINDS = ("file", "module", "package", "workspace", "repository")
BINDING_KINDS = ("parameter", "variable", "type_parameter")
NAMESPACE_KINDS = ("module", "package")

# Relation kinds; the first three are structural.
RELATION_KINDS = (
    "defines", "contains", "owns", "imports", "exports", "reexports", "references", "calls", "reads", "writes", "mutates", "uses_type", "returns",
    "accepts", "throws", "constructs", "instantiates", "inherits", "implements", "overrides", "configured_by", "tested_by", "routes_to", "handles",
    "publishes", "subscribes",
)
STRUCTURAL = ("defines", "contains", "owns")
STATES = ("resolved", "pending", "ambiguous", "unresolved", "inferred")
UNCERTAINTY = {"ambiguous": 0, "unresolved": 1, "pending": 2, "inferred": 3, "resolved": 4}
REASONS = ("no_candidate", "ambiguous", "external", "dynamic", "parse_error", "unsupported", "local_binding")

# Evidence classes and their strength.
STRENGTH = {
    "containment": 100, "import_binding": 90, "receiver_type": 85, "path_match": 80, "qualified_name_in_scope": 70, "same_file": 50, "unique_name": 40,
    "name_only": 10, "local_binding": 0,
}

# Languages and their file extensions, in the order in which they claim them.
LANGUAGES = {
    "typescript": ("ts", "tsx", "mts", "cts"), "javascript": ("js", "jsx", "mjs", "cjs"), "python": ("py", "pyi", "pyw"), "rust": ("rs",), "go": ("go",),
    "java": ("java",), "csharp": ("cs",), "c": ("c", "h"), "cpp": ("cpp", "cc", "cxx", "hpp", "hh", "hxx", "c++", "h++"), "kotlin": ("kt", "kts"),
    "swift": ("swift",), "ruby": ("rb", "rake"), "php": ("php",), "scala": ("scala", "sc"), "elixir": ("ex", "exs"), "erlang": ("erl", "hrl"),
    "dart": ("dart",), "lua": ("lua",), "r": ("r",), "julia": ("jl",), "haskell": ("hs", "lhs"), "ocaml": ("ml", "mli"),
    "clojure": ("clj", "cljs", "cljc", "edn"), "bash": ("sh", "bash", "zsh"), "objectivec": ("m", "mm"), "zig": ("zig",),
}
ALIASES = {"ts": "typescript", "js": "javascript", "py": "python", "rs": "rust", "golang": "go", "c#": "csharp", "cs": "csharp", "c++": "cpp", "kt": "kotlin",
           "rb": "ruby", "sh": "bash", "shell": "bash", "objc": "objectivec", "objective-c": "objectivec"}

# Directories that a walk leaves out.
VCS_NAMES = (".git", ".hg", ".svn", ".jj", "CVS")
NOISE_NAMES = (
    "node_modules", "target", "dist", "build", "__pycache__", ".venv", "venv", ".mypy_cache", ".pytest_cache", ".ruff_cache", ".tox", ".next", ".nuxt",
    ".svelte-kit", ".parcel-cache", ".gradle", ".terraform", "Pods", "DerivedData", "_build", "elm-stuff", "zig-cache", "zig-out", ".cache", "coverage",
    ".idea", ".vscode",
)

# What marks a file as vendored, generated or test code.
VENDORED_DIRS = ("vendor", "vendors", "third_party", "thirdparty", "third-party", "extern", "external", "gopath", "pods", "packages")
GENERATED_DIRS = ("generated", "gen", "__generated__", "autogen", "proto_gen", "protos_gen")
TEST_DIRS = ("test", "tests", "testing", "spec", "specs", "__tests__", "testdata", "e2e", "integration_tests", "fixtures")
GENERATED_MARKERS = (
    "code generated by", "code generated", "automatically generated", "auto-generated", "autogenerated", "do not edit", "do not modify", "generated by",
    "generated file", "this file is generated", "generated from", "@generated",
)
GENERATED_NAMES = (
    "_pb2.py", "_pb2_grpc.py", "_pb.js", "_pb.d.ts", ".pb.go", ".pb.cc", ".pb.h", ".pb.hpp", ".min.js", ".min.mjs", ".min.css", ".d.ts", ".g.dart",
    ".freezed.dart", ".mocks.dart", ".designer.cs", ".g.cs", ".g.iots", ".generated.", ".gen.",
)
TEST_PREFIXES = ("test_", "test-")
TEST_SUFFIXES = ("_test.", "_tests.", "_spec.", "_specs.", ".test.", ".tests.", ".spec.", ".specs.")
TEST_NAMES = ("conftest.py", "conftest.js", "setup.py")
HEADER_BYTES = 2048
MAX_FILE_BYTES = 2 * 1024 * 1024

# Default limits of the queries.
RELATIONS_PER_ENTITY = 64
MAX_VISITED = 512
MAX_UNITS = 256
ENTITIES_PER_FILE = 2000
CHAIN_DEPTH = 4
MAX_CANDIDATES = 32
BYTES_PER_TOKEN = 3

ENTITY_SCHEMA = (
    "path string, kind string, kind_ord int, qualified_name string, entity_ordinal int, name string, signature string, doc string, start_byte int, "
    "end_byte int, start_line int, start_column int, end_line int, end_column int, language string, is_test boolean, structural_fingerprint string"
)
RELATION_SCHEMA = (
    "kind string, source_path string, source_kind string, source_qualified_name string, source_ordinal int, target_name string, target_path string, "
    "target_kind string, target_qualified_name string, target_ordinal int, start_byte int, end_byte int, start_line int, start_column int, end_line int, "
    "end_column int, resolution_state string, ev_class string, ev_module string, ev_alias string, ev_receiver string, ev_scope string, ev_binder string, "
    "basis string, reason string"
)
ENTITY_KEY = ("path", "kind", "qualified_name", "entity_ordinal")
RELATION_KEY = (
    "kind", "source_path", "source_kind", "source_qualified_name", "source_ordinal", "target_name", "start_byte", "end_byte", "start_line", "start_column",
    "end_line", "end_column",
)
CANDIDATE_SCHEMA = "relation_id long, ordinal int, path string, kind string, qualified_name string, entity_ordinal int"
SCHEMA_VERSION = 2
