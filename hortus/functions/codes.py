"""Reject codes of the change jobs.

Fixed values: the numeric codes and their meaning are those of the order
system, so that a user switching over sees the same code for the same
refusal.  ``DUPLICATE`` and ``UNKNOWN_KEY`` stand for the bare key errors the
order system returns without a code; ``OUT_OF_ORDER`` and ``INVALID`` are
engine codes for request batches (a change dated before the state it
changes; a value outside its domain).
"""

from __future__ import annotations

# Code -> meaning, in code order.
REASONS: dict[str, str] = {
    "45000": "Mismatch between code type and customer type",
    "45001": "Wrong code inserted",
    "45002": "Favourite contact not set for current user",
    "45005": "Only owners can make changes to an order",
    "45006": "Selected quantity is higher than current stock",
    "45007": "It is not possible to modify an order already closed",
    "45008": "Species already in order",
    "45009": "Neither customer nor referent own this contact",
    "45010": "Contact already inserted",
    "45011": "User already exists",
    "45012": "Cannot remove the contact because it is associated to an order",
    "45013": "Cannot set this contact as favourite one because it is not owned yet",
    "45014": "Species does not exist",
    "45015": "Selected quantity greater than that not processed yet",
    "45016": "Not existent order",
    "45018": "Supply availability already inserted",
    "45019": "Green species cannot be colorful",
    "45020": "Species does not belong to the order",
    "45021": "Species already stored",
    "45022": "Types of species allowed: 1 or 0",
    "45023": "Fiscal code expression not valid",
    "45024": "Request species not available",
    "45025": "Either species or supplier does not exist",
    "45026": "Either species or pack does not exist",
    "45027": "Either species or order does not exist",
    "45029": "Cannot remove the species because it is associated to an order",
    "45030": "Coloring already specified for selected species",
    "45031": "Address already inserted",
    "45032": "Supplier does not exist",
    "45034": "Order not yet finalized",
    "45035": "Supplier already inserted",
    "DUPLICATE": "Duplicate key",
    "UNKNOWN_KEY": "Referenced key does not exist",
    "OUT_OF_ORDER": "Request dated before the state it changes",
    "INVALID": "Value outside its domain",
}

# Shapes of a personal fiscal code and of a VAT number, anchored at both ends.
FISCAL_CODE = r"^[A-Za-z]{6}[0-9]{2}[A-Za-z][0-9]{2}[A-Za-z][0-9]{3}[A-Za-z]$"
VAT_NUMBER = r"^[0-9]{11}$"

NOT_OWNER = "45005"
MISMATCH_TYPE = "45000"
BAD_CUSTOMER_CODE = "45001"
NO_PREFERRED_CONTACT = "45002"
ABOVE_STOCK = "45006"
ORDER_FINALIZED = "45007"
ALREADY_IN_ORDER = "45008"
CONTACT_NOT_OWNED = "45009"
CONTACT_EXISTS = "45010"
CUSTOMER_EXISTS = "45011"
CONTACT_IN_USE = "45012"
CONTACT_UNKNOWN = "45013"
UNKNOWN_SPECIES = "45014"
ABOVE_REMAINDER = "45015"
UNKNOWN_ORDER = "45016"
AVAILABILITY_EXISTS = "45018"
GREEN_NO_COLOUR = "45019"
NOT_IN_ORDER = "45020"
SPECIES_EXISTS = "45021"
BAD_FLAG = "45022"
BAD_FISCAL_CODE = "45023"
NOT_OFFERED = "45024"
UNKNOWN_SUPPLIER_OR_SPECIES = "45025"
UNKNOWN_PACK = "45026"
UNKNOWN_PACK_ORDER = "45027"
SPECIES_IN_USE = "45029"
COLOUR_EXISTS = "45030"
ADDRESS_EXISTS = "45031"
UNKNOWN_SUPPLIER = "45032"
ORDER_OPEN = "45034"
SUPPLIER_EXISTS = "45035"
DUPLICATE = "DUPLICATE"
UNKNOWN_KEY = "UNKNOWN_KEY"
OUT_OF_ORDER = "OUT_OF_ORDER"
INVALID = "INVALID"

ACCEPTED = "accepted"
NOOP = "noop"
REJECTED = "rejected"
