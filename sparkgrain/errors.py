"""What the engine refuses, and why: raised before any job, save failed audits."""

from __future__ import annotations

from collections.abc import Iterable
from difflib import get_close_matches


class SpecError(Exception):
    """A refusal with the place in the spec that caused it; it may hold several."""

    def __init__(self, message: str, at: str = "", causes: Iterable["SpecError"] = ()):
        self.at, self.causes = at, tuple(causes)
        super().__init__(f"{at}: {message}" if at else message)

    @staticmethod
    def batch(found: list["SpecError"]) -> None:
        """Raise nothing, the one refusal, or one that holds all of them in order of place."""
        if len(found) == 1:
            raise found[0]
        if found:
            found = sorted(found, key=lambda e: (e.at, type(e).__name__, str(e)))
            raise GuardrailError("; ".join(str(e) for e in found), causes=found)


class ParseError(SpecError): ...
class UnknownTransform(SpecError): ...
class ChainTypeError(SpecError): ...
class TransformRegistration(SpecError): ...
class ResolutionError(SpecError): ...
class CircularDerivation(ResolutionError): ...
class MissingReference(ResolutionError): ...
class GuardrailError(SpecError): ...
class UnitMismatch(GuardrailError): ...
class TaxBasisMismatch(GuardrailError): ...
class CurrencyMismatch(GuardrailError): ...
class GrainMismatch(GuardrailError): ...
class AdditivityViolation(GuardrailError): ...
class GrainViolation(GuardrailError): ...
class FanoutRisk(GuardrailError): ...
class HistoricalFanout(GuardrailError): ...
class MissingTimeDimension(GuardrailError): ...
class AssertTyping(GuardrailError): ...
class RetentionMissing(GuardrailError): ...
class TieBreakMissing(GuardrailError): ...
class DispositionConflict(GuardrailError): ...
class IngestionMetadataMissing(GuardrailError): ...
class RedactionConflict(GuardrailError): ...
class StepError(SpecError): ...
class UnknownStep(StepError): ...
class StepDeterminism(StepError): ...
class StepContract(StepError): ...
class EvolutionError(SpecError): ...
class ContractViolation(EvolutionError): ...
class RenameTargetMissing(EvolutionError): ...
class Unsupported(SpecError): ...
class RequestError(SpecError): ...
class UnknownMember(RequestError): ...
class UnreachableAtGrain(RequestError): ...
class AmbiguousDimension(RequestError): ...
class InvalidRequest(RequestError): ...
class FilterType(RequestError): ...
class UnsupportedFilter(RequestError): ...
class FilterTooComplex(UnsupportedFilter): ...
class UnsupportedNegation(UnsupportedFilter): ...
class UnsupportedSort(RequestError): ...
class UnsupportedPagination(RequestError): ...
class AuditFailed(SpecError): ...
class ConcurrentWrite(SpecError): ...


def nearest(name: str, known: Iterable[str]) -> str:
    """A hint at the known name that is meant, if one is near."""
    near = get_close_matches(name, sorted(known), 1)
    return f" (did you mean {near[0]!r}?)" if near else ""
