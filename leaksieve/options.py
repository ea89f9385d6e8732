"""Options that change results."""

from __future__ import annotations

import json
import tomllib
from collections.abc import Mapping
from dataclasses import dataclass, field, replace

# Parameters of config files, and the options they set.
GENERAL_PARAMETERS = {
    "report_format": "report_format",
    "post_comment": "post_comment",
    "skip_comment": "skip_comment",
    "show_matched_secret_on_logs": "show_matched_secret",
}
COMMENT_PARAMETERS = ("bot_name", "message_template", "secret_manager", "contact_help", "label")
# The message template's variables and defaults of a scan's comment.
COMMENT_VARIABLES = ("finding_info", "bot_name", "secret_manager", "contact_help", "label")
DEFAULT_TEMPLATE = (
    "Hello, this is {bot_name}. A text posted here looks like it holds sensitive data.\n\n.\n"
    "Details:\n{finding_info}\n.\n\n"
    "If this is a real leak, rotate the credentials and remove the text. To share credentials "
    "safely, please use {secret_manager}.\nQuestions: {contact_help}\n\n{label}"
)


@dataclass(frozen=True)
class MatchOptions:
    """Rule fields that are declared in rule files but off by default."""

    keyword_prefilter: bool = False
    path_filter: bool = False
    allowlist_paths: bool = False
    regex_target: bool = False
    secret_group: bool = False
    entropy_filter: bool = False
    global_path_exclude: bool = False
    global_regex_allowlist: bool = False
    stopword_filter: bool = False
    #: longest mocked text that is kept whole (None: any), and what is kept on each side of the secret beyond it
    mock_limit: int | None = 10_000
    mock_window: int = 2000
    #: mask every match of every rule in mocked texts, not the first rule's secret alone
    mock_all: bool = False

    @classmethod
    def all(cls) -> MatchOptions:
        return cls(*[True] * 9)


@dataclass(frozen=True)
class ScanOptions:
    report_format: str = "native"
    post_comment: bool = False
    skip_comment: bool = False
    show_matched_secret: bool = False
    bot_name: str = "leaksieve bot"
    message_template: str = DEFAULT_TEMPLATE
    secret_manager: str = "a secret manager tool"
    contact_help: str = "your security team"
    label: str = "leaksieve_auto_comment"
    # label looked for in texts that are skipped; it comes from the config, not from ``label``
    config_label: str = "leaksieve_auto_comment"
    scope: str | None = None
    owner: str | None = None
    repo: str | None = None
    branch: str | None = None
    scan_path: str | None = None
    scan_target: str = ""
    server: str = ""
    jira_cloud: bool = True
    tool_name: str = "leaksieve"
    tool_version: str = "0.1.0"
    tool_author: str = "leaksieve contributors"
    info_url: str = ""
    match: MatchOptions = field(default_factory=MatchOptions)
    # spread the texts over this many tasks before matching; for inputs of fewer splits than cores
    tasks: int | None = None

    def set(self, **changes) -> ScanOptions:
        """A copy with some options changed."""
        return replace(self, **changes)

    @classmethod
    def from_config(cls, config: Mapping) -> ScanOptions:
        """Options from the parameters of a config file; the label is also the one that is looked for in texts."""
        general, comment = config.get("general_params") or {}, config.get("comment_params") or {}
        found = {to: general[key] for key, to in GENERAL_PARAMETERS.items() if general.get(key) is not None}
        found |= {key: comment[key] for key in COMMENT_PARAMETERS if comment.get(key) is not None}
        if "label" in found:
            found["config_label"] = found["label"]
        return cls(**found)

    @classmethod
    def load(cls, path: str) -> ScanOptions:
        """Options from a JSON, TOML or YAML config file of the driver."""
        with open(path, "rb") as file:
            raw = file.read()
        if path.endswith(".json"):
            return cls.from_config(json.loads(raw))
        if path.endswith(".toml"):
            return cls.from_config(tomllib.loads(raw.decode()))
        import yaml

        return cls.from_config(yaml.safe_load(raw) or {})

    def arguments(self) -> dict:
        """The options that are named in reports."""
        return {
            "scan_comment": not self.skip_comment,
            "post_comment": self.post_comment,
            "secret_manager": self.secret_manager,
            "contact_help": self.contact_help,
            "label": self.label,
            "report_format": self.report_format,
            "show_matched_secret_on_logs": self.show_matched_secret,
            "scan_target": self.scan_target,
            "scan_scope": self.scope,
        }
