"""Tables: catalog, stored versions, locks."""
