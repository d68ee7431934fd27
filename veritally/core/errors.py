"""Errors of the package; all are ValueErrors."""


class AnalysisError(ValueError):
    """A parameter or a table that an operator can't work with."""


class EffectError(AnalysisError):
    pass


class ControlError(AnalysisError):
    pass


class CatalogueError(AnalysisError):
    pass


class AtlasError(AnalysisError):
    pass


class LadderError(AnalysisError):
    pass


class RedTeamError(AnalysisError):
    pass


def require(condition: bool, message: str, kind: type[AnalysisError] = AnalysisError) -> None:
    if not condition:
        raise kind(message)
