"""Fixed vocabularies of the catalogue, as plain data."""

#: Ordered keyword rules of task classification (keyword, kind, rule id); the first that matches wins.
TASK_RULES = (
    ("fix", "bug_fix", "rule_bugfix_keyword_fix"), ("fixed", "bug_fix", "rule_bugfix_keyword_fix"), ("fixes", "bug_fix", "rule_bugfix_keyword_fix"), ("bugfix", "bug_fix", "rule_bugfix_keyword_fix"),
    ("bug", "bug_fix", "rule_bugfix_keyword_bug"), ("bugs", "bug_fix", "rule_bugfix_keyword_bug"), ("broken", "bug_fix", "rule_bugfix_keyword_bug"),
    ("refactor", "refactor", "rule_refactor_keyword"), ("refactoring", "refactor", "rule_refactor_keyword"), ("rename", "refactor", "rule_refactor_keyword_rename"), ("renamed", "refactor", "rule_refactor_keyword_rename"),
    ("api", "api_change", "rule_api_change_keyword"), ("interface", "api_change", "rule_api_change_keyword_interface"),
    ("configuration", "configuration_change", "rule_configuration_change_keyword"), ("configure", "configuration_change", "rule_configuration_change_keyword"), ("config", "configuration_change", "rule_configuration_change_keyword"),
    ("tests", "test_change", "rule_test_change_keyword"), ("test", "test_change", "rule_test_change_keyword"),
    ("review", "review", "rule_review_keyword"), ("audit", "audit", "rule_audit_keyword"),
    ("explore", "explore", "rule_explore_keyword"), ("investigate", "explore", "rule_explore_keyword_investigate"), ("understand", "explore", "rule_explore_keyword_understand"),
    ("changes", "behavior_change", "rule_behavior_change_keyword"), ("change", "behavior_change", "rule_behavior_change_keyword"), ("adding", "behavior_change", "rule_behavior_change_keyword_add"), ("add", "behavior_change", "rule_behavior_change_keyword_add"),
)
DEFAULT_TASK_RULE = ("unknown", "rule_default_unknown")

#: Path patterns by class, in the order in which classes are tried (class code, state, patterns).
PATH_RULES = (
    ("self_exclusion", "excluded", (r"(^|/)\.stratalog/",)),
    ("secret_path_excluded", "secret_excluded", (r"\.env(\.[^/]+)?$", r"(^|/)id_rsa$", r"(^|/)id_ed25519$", r"\.pem$", r"\.key$", r"(^|/)secrets?\.ya?ml$", r"(^|/)credentials?\.json$", r"(^|/)cookies?\.(sqlite|json)$", r"(^|/)netrc$", r"(^|/)service-account\.json$", r"(^|/)\.npmrc$", r"(^|/)\.pypirc$")),
    ("vendor_path", "excluded", (r"(^|/)node_modules/", r"(^|/)vendor/", r"(^|/)\.venv/", r"(^|/)venv/", r"(^|/)__pycache__/", r"(^|/)\.uv-cache/")),
    ("build_path", "excluded", (r"(^|/)dist/", r"(^|/)build/", r"(^|/)out/", r"(^|/)target/", r"(^|/)\.next/", r"(^|/)\.turbo/", r"(^|/)\.cache/")),
    ("generated_path", "excluded", (r"(^|/).*\.min\.js$", r"(^|/).*\.min\.css$", r"(^|/).*\.gen\.ts$", r"(^|/)generated/", r"(^|/).*\.pb\.go$")),
    ("binary_path", "excluded", (r"(^|/).*\.png$", r"(^|/).*\.jpg$", r"(^|/).*\.jpeg$", r"(^|/).*\.gif$", r"(^|/).*\.webp$", r"(^|/).*\.pdf$", r"(^|/).*\.zip$", r"(^|/).*\.7z$", r"(^|/).*\.tar(\.[a-z0-9]+)?$", r"(^|/).*\.exe$", r"(^|/).*\.dll$", r"(^|/).*\.so$", r"(^|/).*\.dylib$", r"(^|/).*\.bin$")),
    ("archive_jar", "excluded", (r"(.*)\.jar$",)), ("archive_war", "excluded", (r"(.*)\.war$",)), ("archive_wheel", "excluded", (r"(.*)\.whl$",)), ("archive_gem", "excluded", (r"(.*)\.gem$",)), ("archive_deb", "excluded", (r"(.*)\.deb$",)), ("archive_rpm", "excluded", (r"(.*)\.rpm$",)),
    ("archive_directory", "excluded", (r"(^|/)archive/",)),
)

#: Artifact class by extension.
ARTIFACT_CLASSES = {
    "documentation": ("md", "markdown", "txt", "rst", "adoc"),
    "configuration": ("json", "yaml", "yml", "toml", "ini", "cfg", "conf", "env"),
    "build_manifest": ("lock",),
    "source": ("py", "rs", "ts", "tsx", "js", "jsx", "go", "java", "c", "cpp", "h", "hpp", "cs", "rb", "php", "sh", "sql"),
    "binary_metadata": ("png", "jpg", "jpeg", "gif", "webp", "pdf", "zip", "7z", "tar", "gz", "bz2", "xz", "exe", "dll", "so", "dylib", "class", "jar", "war"),
}

#: Default rank of evidence tiers.
TIER_RANK = {"compiler": 900, "runtime_observation": 850, "semantic_index": 800, "language_server": 700, "structural": 500, "document_config": 300, "textual": 100, "heuristic": 50}
