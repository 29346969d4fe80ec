"""Exceptions of the library."""


class SkyAdjustError(Exception):
    """Anything this library raises on purpose."""


class ConfigError(SkyAdjustError):
    """A configuration that cannot be read."""


class DataModelError(SkyAdjustError):
    """Input that does not fit the data model, such as an image without a camera."""


class MatcherError(SkyAdjustError):
    """A matcher that is unknown, registered twice or returns uneven lists."""


class WeightFileNotFoundError(MatcherError):
    """A learned matcher without its weights."""
