"""Model settings (the knobs of the unified event model)."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

ENTITY_FLAG_NAMES = (
    "enable_app_errors", "enable_application_context", "enable_browser_context",
    "enable_browser_context_2", "enable_client_session_context", "enable_deep_link_context",
    "enable_geolocation_context", "enable_iab", "enable_mobile_context", "enable_screen_context",
    "enable_screen_summary_context", "enable_ua", "enable_web_page", "enable_yauaa",
)


@dataclass(frozen=True)
class ModelConfig:
    """Settings of the modelled views.

    ``app_ids`` empty means all applications.  ``flags`` maps the entity
    feature toggles to on/off; a disabled entity yields NULL columns.
    ``session_field`` is the client-session field used as session key
    (``sessionId`` reproduces the original reading, ``session_id`` the intent).
    """

    app_ids: tuple[str, ...] = ()
    heartbeat: int = 10
    min_visit_length: int = 5
    ua_bot_filter: bool = True
    flags: dict = field(default_factory=lambda: {n: n == "enable_web_page" for n in ENTITY_FLAG_NAMES})
    session_field: str = "sessionId"

    def enabled(self, flag: str) -> bool:
        return bool(self.flags.get(flag, False))

    def with_all_entities(self) -> "ModelConfig":
        return replace(self, flags={n: True for n in ENTITY_FLAG_NAMES})

    def __hash__(self):  # dict field: hash by value
        return hash((self.app_ids, self.heartbeat, self.min_visit_length, self.ua_bot_filter,
                     tuple(sorted(self.flags.items())), self.session_field))


def fixture_config() -> ModelConfig:
    """Settings used with the ``atomic`` test fixture."""
    return ModelConfig(app_ids=("demo-app",)).with_all_entities()
