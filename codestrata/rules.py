"""Rule tables: file types, technologies, entry files, prunes, sensitive places, purposes."""

from __future__ import annotations

# Extension -> file type.
EXTENSION_TYPES = {
    ".js": "javascript", ".mjs": "javascript", ".cjs": "javascript", ".jsx": "javascript", ".ts": "typescript", ".tsx": "typescript",
    ".css": "stylesheet", ".json": "data", ".html": "markup", ".sql": "sql", ".py": "python", ".pyw": "python", ".php": "php",
    ".cs": "csharp", ".sln": "sln", ".csproj": "csproj", ".config": "config", ".xaml": "xaml", ".rs": "rust", ".java": "java",
    ".go": "go", ".c": "c", ".h": "c", ".cpp": "cpp", ".cc": "cpp", ".cxx": "cpp", ".toml": "toml", ".lock": "lock", ".rb": "ruby",
    ".rake": "ruby", ".gemspec": "ruby", ".ini": "ini", ".cfg": "ini", ".ps1": "powershell", ".psm1": "powershell",
}
# Whole names that override the extension.
NAME_TYPES = {"Cargo.toml": "cargotoml", "Cargo.lock": "cargolock", "rust-toolchain.toml": "rusttoolchain"}
UNPARSED = ("data", "toml", "lock", "unknown")

# Technologies by whole name and by extension, in order of rank.
TECH_NAMES = {"package.json": "Node.js", "requirements.txt": "Python", "pom.xml": "Java", "index.html": "Frontend", "Cargo.toml": "Rust", "go.mod": "Go", "Gemfile": "Ruby", "Gemfile.lock": "Ruby", "Rakefile": "Ruby"}
TECH_EXTENSIONS = {
    ".js": "JavaScript", ".mjs": "JavaScript", ".cjs": "JavaScript", ".jsx": "JavaScript", ".ts": "TypeScript", ".tsx": "TypeScript",
    ".css": "CSS", ".html": "HTML", ".sql": "SQL", ".py": "Python", ".pyw": "Python", ".php": "PHP", ".cs": "C#", ".csproj": "C#",
    ".sln": "C#", ".xaml": "C#", ".rs": "Rust", ".java": "Java", ".go": "Go", ".c": "C", ".h": "C", ".cpp": "C++", ".cc": "C++",
    ".cxx": "C++", ".rb": "Ruby", ".rake": "Ruby", ".gemspec": "Ruby", ".ini": "INI", ".cfg": "INI", ".ps1": "PowerShell", ".psm1": "PowerShell",
}
# Entry files of a technology.
ENTRY_FILES = {
    "Node.js": ("index.js", "server.js", "app.js"), "Python": ("main.py", "app.py"), "Frontend": ("index.html",), "Java": ("Main.java",),
    "Rust": ("main.rs", "lib.rs"), "Go": ("main.go",), "C#": ("Program.cs", "Main.cs"), "C": ("main.c",), "C++": ("main.cpp",),
    "Ruby": ("main.rb", "app.rb", "config.ru"), "PowerShell": ("main.ps1",),
}
# Names whose subtrees are skipped.
IGNORED = ("node_modules", ".git", "dist", "build", "coverage", ".env", "generated")
# Places that are never analysed.
SENSITIVE = (
    "/etc", "/proc", "/sys", "/dev", "/boot", "/bin", "/sbin", "/lib", "/lib64", "/usr", "/var", "/opt", "/root",
    "C:\\Windows", "C:\\Program Files", "C:\\Program Files (x86)", "C:\\System32", "C:\\Boot", "C:\\Recovery",
    "/System", "/Library", "/private", "/cores", "/Volumes",
)
MAX_FILE_BYTES, MAX_FILES, MAX_TOTAL_BYTES = 5 << 20, 5000, 100 << 20

# What a type is called in a module document.
TYPE_TITLES = {
    "javascript": "JavaScript module", "typescript": "TypeScript module", "markup": "HTML template", "stylesheet": "CSS styles", "sql": "SQL script",
    "python": "Python module", "php": "PHP module", "csharp": "C# module", "sln": "Solution file", "csproj": "C# project file", "config": "Configuration file",
    "xaml": "XAML view", "rust": "Rust module", "java": "Java module", "go": "Go module", "c": "C source file", "cpp": "C++ source file",
    "ruby": "Ruby script/module", "ini": "INI configuration", "powershell": "PowerShell script/module",
}
# Purposes by part of the lower-cased name, first match wins.
_SCRIPT = (
    (("config", "settings"), "Application configuration"), (("route", "router"), "Route definitions"), (("middleware",), "Request middleware handlers"),
    (("controller",), "Request handlers and business logic"), (("model", "schema"), "Data models and validation"), (("service",), "Service layer business logic"),
    (("util", "helper"), "Utility functions and helpers"), (("test", "spec"), "Unit and integration tests"), (("index",), "Module entry point"),
    (("server", "app", "main"), "Application entry point"),
)
PURPOSES = {
    "sql": (
        (("schema", "create", "init"), "Database schema initialization"), (("seed", "data"), "Seed data for initial population"), (("migrat",), "Database migration script"),
        (("drop", "delete", "destroy"), "Database cleanup script"), (("backup", "export"), "Database backup script"), (("view", "v_"), "Database view definition"),
        (("procedure", "sp_", "fn_"), "Stored procedure definition"), (("",), "SQL script for database operations"),
    ),
    "javascript": _SCRIPT,
    "typescript": _SCRIPT,
    "php": (
        (("config", "settings"), "Application configuration"), (("route", "router"), "Route definitions"), (("controller",), "Request handlers and business logic"),
        (("model",), "Data models and validation"), (("migration",), "Database migration script"), (("middleware",), "Request middleware handlers"),
        (("test", "spec"), "Unit and integration tests"), (("login", "logout", "auth", "register", "sesion", "session"), "User authentication and session handling"),
        (("admin", "panel"), "Administration panel views and logic"), (("dashboard",), "Main dashboard view"),
        (("conexion", "connection", "database", "db"), "Database connection handling"), (("inscripcion", "enroll", "inscription"), "Membership enrollment form handling"),
        (("membresia", "membership"), "Membership management logic"),
    ),
    "stylesheet": (
        (("variables", "tokens"), "Design tokens and CSS variables"), (("reset", "normalize"), "CSS reset and normalization"), (("layout",), "Layout and grid styles"),
        (("component", "widget"), "Component-specific styles"), (("responsive", "media"), "Responsive design breakpoints"),
    ),
}
# Words of module descriptions, in order: types, long form, short form.
MODULE_WORDS = (
    (("sql",), "SQL scripts and database objects", "SQL scripts"), (("javascript", "typescript"), "JavaScript application logic", "JavaScript"),
    (("php",), "PHP application logic", "PHP"), (("python",), "Python application logic", "Python"), (("ruby",), "Ruby application logic", "Ruby"),
    (("stylesheet",), "CSS styles", "CSS"), (("markup",), "HTML templates", "HTML"), (("rust",), "Rust modules", "Rust"), (("java",), "Java modules", "Java"),
    (("go",), "Go modules", "Go"), (("csharp",), "C# modules", "C#"), (("config",), "Configuration files", "Configuration"),
)
# SQL dialect marks, first match wins; (pattern, ignores case, dialect).
DIALECTS = (
    (r"\[[\w@#]+\]", False, "transactsql"), (r"\bTOP\b", True, "transactsql"), (r"\bIDENTITY\b", True, "transactsql"), (r"\bOUTPUT\b", True, "transactsql"),
    (r"\bGO\b", True, "transactsql"), (r"`.*?`", False, "mysql"), (r"\bAUTO_INCREMENT\b", True, "mysql"), (r"\bSERIAL\b", True, "postgresql"),
    (r"\b::\b", False, "postgresql"), (r"\bPLPGSQL\b", True, "postgresql"), (r"\bDATABASE\b", True, "mysql"),
)
# Fixed value: output text.
EMPTY_NOTE = "Pendiente de implementar"

# Words that are no parameter names of an SQL routine.
NO_PARAMETERS = frozenset("DECLARE SET SELECT INSERT UPDATE DELETE FROM WHERE AS BEGIN END RETURN RETURNS TABLE IF ELSE WHILE CURSOR FETCH COMMIT ROLLBACK PRINT RAISERROR THROW TRY CATCH".split())
