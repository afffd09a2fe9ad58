"""The domain jobs, composed from functions and operators."""
