"""Errors for bad arguments, and the row-level codes that bad rows carry instead of failing a job.

A batch never stops at a bad row: operators put `status`, `error_code` and `error_message` beside it.
The classes below are raised for bad arguments only; their names double as the codes.
"""

from __future__ import annotations


class LoomError(Exception):
    """Base of all errors of this package."""

    @classmethod
    def code(cls) -> str:
        out = cls.__name__.removesuffix("Error")
        return "".join("_" * (c.isupper() and i > 0) + c.lower() for i, c in enumerate(out))


class IngestionError(LoomError): ...


class FileMissingError(IngestionError): ...


class EmptyFileError(IngestionError): ...


class FileTooLargeError(IngestionError): ...


class UnsupportedFormatError(IngestionError): ...


class InvalidDocumentError(IngestionError): ...


class NoExtractableTextError(InvalidDocumentError): ...


class OcrLimitExceededError(InvalidDocumentError): ...


class OcrUnavailableError(IngestionError): ...


class OcrPageError(IngestionError): ...


class RetrievalError(LoomError): ...


class InvalidQueryError(RetrievalError): ...


class InvalidTopKError(InvalidQueryError): ...


class RerankingError(LoomError): ...


class InvalidCandidatesError(RerankingError): ...


class GenerationError(LoomError): ...


class InvalidContextError(GenerationError): ...


class EmptyAnswerError(GenerationError): ...


class OrchestrationError(LoomError): ...


class IndexingError(OrchestrationError): ...


class QueryError(OrchestrationError): ...


class EmptyRetrievalError(QueryError): ...


class InsufficientContextError(EmptyRetrievalError): ...
