"""Outreach message texts (email subjects and bodies, SMS texts, tone templates).

These strings must equal the reference's messages word for word. Placeholders are ``{name}`` tokens filled by
:mod:`receivables.operators.outreach` with Spark string expressions:

- ``{customer_name}``, ``{invoice_id}``, ``{days_overdue}``
- ``{amount}`` = amount with thousands separators and 2 decimals, ``{amount0}`` = same with 0 decimals
- ``{installment}`` = amount / 3 with 2 decimals
- ``{due_date}`` = "Month DD, YYYY"
- ``{payment_instructions}``, ``{company_name}``, ``{company_phone}``, ``{company_email}``

Tone templates (``TONE_TEMPLATES``) keep their Jinja-style ``{{ name }}`` tokens.
"""

# Sender defaults.
COMPANY_NAME = "Your Company"
COMPANY_PHONE = "(555) 123-4567"
COMPANY_EMAIL = "accounts@company.com"

# Payment instruction block (the online line appears only when a payment link is given).
PAYMENT_INSTRUCTIONS_HEAD = "Payment Options:"
PAYMENT_INSTRUCTIONS_LINK = "\n• Pay Online: {payment_link}"
PAYMENT_INSTRUCTIONS_TAIL = """
• Bank Transfer: Contact us for ACH details
• Check: Mail to {company_name}
• Phone: Call {company_phone} to pay by card"""

# Email subject and body per action type.
EMAIL_TEMPLATES = {
    "friendly_reminder": (
        "Friendly Reminder: Invoice #{invoice_id} - ${amount}",
        """Dear {customer_name},

I hope this message finds you well!

This is a friendly reminder that Invoice #{invoice_id} for ${amount} was due on {due_date} ({days_overdue} days ago).

We understand that oversights happen, and we wanted to reach out to see if there's anything we can help with regarding this payment.

Invoice Details:
• Invoice Number: {invoice_id}
• Amount Due: ${amount}
• Original Due Date: {due_date}
• Days Overdue: {days_overdue}

{payment_instructions}

If you've already sent payment, please disregard this message and accept our thanks! If you have any questions or need to discuss payment options, please don't hesitate to contact us.

Thank you for your business!

Best regards,
Accounts Receivable Team
{company_name}
{company_phone}
{company_email}
""",
    ),
    "second_notice": (
        "SECOND NOTICE: Invoice #{invoice_id} - Payment Required",
        """Dear {customer_name},

This is our second notice regarding Invoice #{invoice_id} for ${amount}, which is now {days_overdue} days overdue.

We have not yet received payment for this invoice, which was originally due on {due_date}.

Outstanding Invoice:
• Invoice Number: {invoice_id}
• Amount Due: ${amount}
• Due Date: {due_date}
• Days Overdue: {days_overdue}
• Late Fee (if applicable): Accruing

{payment_instructions}

IMPORTANT: To avoid any interruption in service or additional late fees, please remit payment within the next 5 business days.

If you are experiencing difficulty making this payment, please contact us immediately to discuss payment arrangement options. We are here to work with you.

If payment has been sent, please reply with payment confirmation details.

Sincerely,
Accounts Receivable Department
{company_name}
{company_phone}
{company_email}
""",
    ),
    "call_request": (
        "URGENT: Let's Discuss Invoice #{invoice_id} - ${amount}",
        """Dear {customer_name},

We need to discuss Invoice #{invoice_id} for ${amount}, which is now {days_overdue} days past due.

Despite previous communications, this invoice remains unpaid. We would like to speak with you directly to resolve this matter.

Invoice Summary:
• Invoice Number: {invoice_id}
• Amount Due: ${amount}
• Due Date: {due_date}
• Days Overdue: {days_overdue}

ACTION REQUIRED:
Please call us at {company_phone} within 48 hours to discuss this account. Our office hours are Monday-Friday, 9 AM - 5 PM.

Alternatively, you can reply to this email with a convenient time for us to call you.

We value our business relationship and want to resolve this matter promptly. Payment arrangements may be available if you're experiencing financial difficulties.

Time-Sensitive Matter - Please Respond Immediately

{company_name} - Accounts Receivable
{company_phone}
{company_email}
""",
    ),
    "escalate": (
        "FINAL NOTICE: Invoice #{invoice_id} - Immediate Action Required",
        """Dear {customer_name},

FINAL NOTICE

This is our final attempt to collect payment for Invoice #{invoice_id} before escalating this matter.

Critical Account Status:
• Invoice Number: {invoice_id}
• Amount Due: ${amount}
• Original Due Date: {due_date}
• Days Overdue: {days_overdue}
• Status: SERIOUSLY DELINQUENT

We have made multiple attempts to contact you regarding this overdue invoice. Unfortunately, we have not received payment or any response to our previous communications.

IMMEDIATE ACTION REQUIRED:
You have 72 hours from receipt of this notice to either:
1. Pay the full amount due, OR
2. Contact us to arrange an approved payment plan

Failure to respond will result in:
• Account suspension/service interruption
• Referral to collections agency
• Negative impact on business credit
• Potential legal action

{payment_instructions}

We sincerely hope to avoid these measures. Please contact us immediately at {company_phone} or reply to this email.

This is a formal notice of debt collection.

{company_name}
Collections Department
{company_phone}
{company_email}
""",
    ),
    "payment_plan": (
        "Payment Plan Available: Invoice #{invoice_id}",
        """Dear {customer_name},

We understand that businesses sometimes face cash flow challenges. We want to work with you to resolve Invoice #{invoice_id}.

Outstanding Amount: ${amount}
Days Overdue: {days_overdue}

PAYMENT PLAN OFFER:
We can arrange a payment plan to help you clear this balance:

Option 1 - Three Monthly Installments:
• Payment 1: ${installment} (Due immediately)
• Payment 2: ${installment} (Due in 30 days)
• Payment 3: ${installment} (Due in 60 days)

Option 2 - Custom Arrangement:
Contact us to discuss a plan that works for your situation.

To accept this payment plan:
1. Reply to this email confirming your chosen option
2. Make the first payment within 5 business days
3. We'll send you a payment agreement to sign

This is a limited-time offer to help you avoid further collection actions and maintain our business relationship.

Please respond within 48 hours to secure this arrangement.

We're here to help!

Best regards,
{company_name}
{company_phone}
{company_email}
""",
    ),
    "thank_you": (
        "Payment Received - Thank You! (Invoice #{invoice_id})",
        """Dear {customer_name},

Thank you! We've received your payment of ${amount} for Invoice #{invoice_id}.

Payment Details:
• Invoice Number: {invoice_id}
• Amount Paid: ${amount}
• Status: PAID IN FULL

Your account is now current. We appreciate your prompt attention to this matter and value your continued business.

If you have any questions about this payment or your account, please don't hesitate to contact us.

Thank you for being a valued customer!

Best regards,
{company_name}
{company_phone}
{company_email}
""",
    ),
}

# SMS text per action type.
SMS_TEMPLATES = {
    "friendly_reminder": "{company_name}: Hi {customer_name}, friendly reminder Invoice #{invoice_id} (${amount0}) is {days_overdue} days past due. Pay at {company_email}",
    "second_notice": "{company_name}: NOTICE: Invoice #{invoice_id} (${amount0}) is {days_overdue} days overdue. Please pay immediately or call {company_phone}",
    "call_request": "{company_name}: URGENT - Please call us at {company_phone} about Invoice #{invoice_id} (${amount0}), {days_overdue} days past due",
    "escalate": "{company_name}: FINAL NOTICE - Invoice #{invoice_id} (${amount0}) MUST be paid within 72hrs to avoid collections. Call {company_phone}",
    "payment_plan": "{company_name}: Payment plan available for Invoice #{invoice_id} (${amount0}). Reply YES or call {company_phone} to discuss options",
    "thank_you": "{company_name}: Payment received! Thank you for paying Invoice #{invoice_id} (${amount0}). Your account is current.",
}

DEFAULT_ACTION = "friendly_reminder"

# Tone templates keyed by (channel, tone); text as shipped, without the final newline.
TONE_TEMPLATES = {
    ("email", "friendly"): """Subject: Friendly reminder: Invoice {{ invoice_id }} payment

Dear {{ customer_name }},

I hope this message finds you well!

This is a friendly reminder that invoice {{ invoice_id }} for ${{ invoice_amount }} was due on {{ due_date }}.

Invoice Details:
- Invoice #: {{ invoice_id }}
- Amount: ${{ invoice_amount }}
- Due Date: {{ due_date }}
- Days {{ "overdue" if days_overdue > 0 else "until due" }}: {{ days_overdue if days_overdue > 0 else days_until_due }}

We understand that oversights happen. If you've already sent the payment, please disregard this message and accept our thanks!

If there's anything preventing you from making this payment, or if you have questions about the invoice, please don't hesitate to reach out. We're here to help and happy to discuss payment arrangements if needed.

You can view and pay your invoice here: [Payment Link]

Thank you for your continued partnership!

Best regards,
Accounts Receivable Team""",
    ("email", "neutral"): """Subject: Payment reminder: Invoice {{ invoice_id }}

Dear {{ customer_name }},

This is a payment reminder for invoice {{ invoice_id }}.

Invoice Details:
- Invoice #: {{ invoice_id }}
- Amount Due: ${{ invoice_amount }}
- Original Due Date: {{ due_date }}
- Current Status: {{ days_overdue }} days overdue

This invoice is now past due. We kindly request that you submit payment at your earliest convenience.

If you have questions about this invoice or need to discuss payment terms, please contact us within 3 business days.

Payment options:
- Online: [Payment Link]
- Bank Transfer: [Account Details]
- Check: Mail to [Address]

If payment has already been sent, please reply with the payment confirmation details.

Regards,
Accounts Receivable Department""",
    ("email", "firm"): """Subject: URGENT: Overdue invoice {{ invoice_id }} requires immediate attention

{{ customer_name }},

This is an urgent notice regarding invoice {{ invoice_id }}, which is now significantly overdue.

Invoice Details:
- Invoice #: {{ invoice_id }}
- Amount Due: ${{ invoice_amount }}
- Original Due Date: {{ due_date }}
- Days Overdue: {{ days_overdue }}
- Previous Reminders Sent: {{ prior_reminders }}

Despite previous reminders, payment for this invoice has not been received. Immediate action is required.

REQUIRED ACTION:
You must contact us within 48 hours to either:
1. Submit full payment
2. Arrange a payment plan
3. Provide explanation for the delay

CONSEQUENCES OF NON-PAYMENT:
- Late fees may be applied
- Service interruption may occur
- Account may be escalated to collections
- Credit terms may be affected

We strongly encourage you to resolve this matter promptly to avoid further action.

Contact our Accounts Receivable Department immediately:
Email: [AR Email]
Phone: [AR Phone]

This is a formal notice. Please treat this with appropriate urgency.

Accounts Receivable Department""",
    ("sms", "firm"): "URGENT: Invoice {{ invoice_id }} (${{ invoice_amount }}) is {{ days_overdue }} days overdue. Contact us within 48hrs to avoid service interruption. [contact]",
    ("sms", "friendly"): "Hi {{ customer_name }}! Friendly reminder: Invoice {{ invoice_id }} (${{ invoice_amount }}) was due {{ due_date }}. Any questions? We're here to help! Pay at: [link]",
}
# Fixed value: the conditional line of the friendly email, filled as two tokens.
FRIENDLY_DAYS_LABEL = '{{ "overdue" if days_overdue > 0 else "until due" }}'
FRIENDLY_DAYS_VALUE = "{{ days_overdue if days_overdue > 0 else days_until_due }}"
