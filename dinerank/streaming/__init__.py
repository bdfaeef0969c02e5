"""Structured Streaming form of the request path."""

from dinerank.streaming.requests_stream import answer_request_stream

__all__ = ["answer_request_stream"]
