"""Reading model tables and turning captured shop payloads into offer rows."""
