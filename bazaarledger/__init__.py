"""Marketplace reporting on Spark: merchant payments, refunds, cash collection, P&L, promos, ratings, settlements."""

from .codes import Codes
from .session import configured_session
from .sources.tables import Tables

__all__ = ["Codes", "Tables", "configured_session"]
